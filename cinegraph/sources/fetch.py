"""Dumps fetched from where they are published, if they are newer than what is here."""

from __future__ import annotations

import email.utils
import urllib.error
import urllib.request
import uuid

from pyspark.sql import SparkSession

from cinegraph.schemas import TABLES
from cinegraph.sources import files


def fetch(spark: SparkSession, url: str, path: str, timeout: float = 60) -> bool:
    """Whether a file was fetched to path: it was not there, or what is published is newer, by the server's word.

    The bytes go from stream to stream, whatever their number, to a file beside, which then takes the place of the old one: a fetch that
    breaks off leaves that as it was. The new file has the time that the server gives, for the next question.
    """
    fs, p = files.at(spark, path)
    asked = urllib.request.Request(url, method="HEAD")
    if fs.exists(p):
        asked.add_header("If-Modified-Since", email.utils.formatdate(fs.getFileStatus(p).getModificationTime() / 1000, usegmt=True))
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            changed = answer.headers.get("Last-Modified")
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return False
        raise
    beside = f"{path}.{uuid.uuid4().hex}"
    _, b = files.at(spark, beside)
    source, place = files.at(spark, url)
    try:
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source.open(place), fs.create(b, False), 1 << 20, True)
        fs.delete(p, False)
        if not fs.rename(b, p):
            raise OSError(f"{beside} could not be renamed to {path}")
    finally:
        if fs.exists(b):
            fs.delete(b, False)
    if changed:
        fs.setTimes(p, int(email.utils.parsedate_to_datetime(changed).timestamp() * 1000), -1)
    return True


def fetch_all(spark: SparkSession, base: str, folder: str, minimal: bool = False) -> dict[str, bool]:
    """fetch() of every table's dump below a URL; minimal takes the smaller ones. Their names are those that the loader reads."""
    end = ".minimal.tsv.gz" if minimal else ".tsv.gz"
    return {t: fetch(spark, f"{base.rstrip('/')}/{t.replace('_', '.')}.tsv.gz{'.minimal' if minimal else ''}", f"{folder}/{t.replace('_', '.')}{end}") for t in TABLES}
