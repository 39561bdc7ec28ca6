"""Query registry: each entry pairs a Spark query over the given tables with the SQL that states its answer."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from tieline.views import VIEWS

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _refs(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(text) if f))


class Tables:
    """Lazy access to the parquet tables of one folder and to the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in VIEWS:
                text = VIEWS[name]
                self._seen[name] = self.spark.sql(text, **{r: getattr(self, r) for r in _refs(text)})
            elif name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._seen[name]


def _view_chain(names: Iterable[str], done: dict[str, str]) -> None:
    for n in names:
        if n in VIEWS and n not in done:
            _view_chain(_refs(VIEWS[n]), done)
            done[n] = VIEWS[n].format(**{r: r for r in _refs(VIEWS[n])})


def with_views(sql: str) -> str:
    """Prefix a statement with the view definitions it references as {name}."""
    chain: dict[str, str] = {}
    _view_chain(_refs(sql), chain)
    body = sql.format(**{r: r for r in _refs(sql)}).strip()
    ctes = [f"{n} AS ({t.strip()})" for n, t in chain.items()]
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return register
