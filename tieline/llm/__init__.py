"""Operators for preparing large text collections: filters, deduplication, scoring, mixing and archives.

Nothing outside this folder imports it. The image products of this library carry no prose, so the text operators are
general and work on any table with the named columns; those on links and archived pages (`url_filter`, `warc`) take the
catalog's download pages (page_id, url, html), and site-level operators name a host as a catalog's source archive.
"""
