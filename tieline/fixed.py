"""Physical constants, instrument records, look-up lists and declared thresholds."""

# --- fixed values: lunar sphere -------------------------------------------------------------
MOON_RADIUS_M = 1737400.0
MOON_RADIUS_KM = 1737.4

# --- fixed values: instrument records -------------------------------------------------------
# name, gsd_m, gsd_oblique_m, swath_km, spectral_type, min_um, max_um, num_bands, bit_depth, detector, altitude_km
INSTRUMENTS = [
    ("OHRC", 0.25, 0.32, 3.0, "panchromatic_visible", 0.45, 0.70, 1, 12, "TDI CCD", 100.0),
    ("TMC2", 5.0, None, 20.0, "panchromatic_visible", 0.50, 0.80, 1, 12, "Linear APS array", 100.0),
    ("IIRS", 80.0, None, 20.0, "hyperspectral_infrared", 0.80, 5.00, 256, 12, "HgCdTe MCT", 100.0),
]
INSTRUMENT_SCHEMA = (
    "name string, gsd_m double, gsd_oblique_m double, swath_km double, spectral_type string, "
    "min_um double, max_um double, num_bands int, bit_depth int, detector_type string, orbit_altitude_km double"
)

# --- fixed values: instrument aliases (upper case, punctuation removed) -----------------------
INSTRUMENT_ALIASES = {
    "IIRS": "IIRS",
    "IMAGINGINFRAREDSPECTROMETER": "IIRS",
    "IMAGINGINFRAREDSPECTROMETER2": "IIRS",
    "OHRC": "OHRC",
    "ORBITERHIGHRESOLUTIONCAMERA": "OHRC",
    "TERRAINMAPPINGCAMERA": "TMC2",
    "TERRAINMAPPINGCAMERA2": "TMC2",
    "TMC": "TMC2",
    "TMC2": "TMC2",
}

# --- fixed values: label data types -> storage type, bytes per item ---------------------------
LABEL_DTYPES = [
    ("IEEE754LSBDouble", "<f8", 8),
    ("IEEE754LSBSingle", "<f4", 4),
    ("IEEE754MSBSingle", ">f4", 4),
    ("SignedLSB2", "<i2", 2),
    ("UnsignedByte", "|u1", 1),
    ("UnsignedLSB2", "<u2", 2),
    ("UnsignedMSB2", ">u2", 2),
]

# --- fixed values: residual gates, control arms, gate thresholds ------------------------------
SWEEP_GATES = [15.0, 10.0, 5.0, 3.0, 2.0, 1.0]
REFIT_GATES = [15.0, 10.0, 5.0, 3.0]
CONTROL_ARMS = ["rot90", "rot180", "rot270", "vflip", "hflip", "offset", "uniform_noise"]
GATE = {
    "min_inliers": 20,
    "min_ratio_pct": 15.0,
    "max_condition": 1e5,
    "max_rotation_deg": 30.0,
    "scale_tolerance": 0.25,
    "delta_shuffle_min": 15.0,
}
PROXY_MAX_NM = 2000.0
PROXY_FALLBACK_BANDS = 77
MODEL_ORDER = ["translation", "similarity", "affine", "poly2", "poly3", "pspline", "pspline_relief"]
MIN_SAMPLES = {"translation": 1, "similarity": 2, "affine": 3, "poly2": 6, "poly3": 10}
