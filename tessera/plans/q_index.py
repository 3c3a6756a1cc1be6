"""Catalog entries: the stored full-text index (R11), built and updated."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import textindex as X
from ..oracle.fulltext import index_sql
from ..session import ensure_checkpoint_dir
from ..sources import tables as T
from .catalog import register


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"


@register("r11_index_build", index_sql)
def q_r11(spark, sf):
    """What the index of all documents holds, read back from its tables.  It
    is the index that the full-text queries share: the first call builds it."""
    return X.index_report(T.documents_index(spark, sf))


@register("r11_index_update", index_sql)
def q_r11_update(spark, sf):
    """The same from an index of an older corpus (files missing, others with
    another text or gone since) that is brought up to date."""
    now = T.corpus_from_documents(spark, sf)
    path = _folder(spark)
    kind = F.col("doc_id") % 50
    text = F.when(kind == 1, F.concat(F.lit("older text "), "content")).otherwise(F.col("content"))
    name = F.when(kind == 2, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))
    X.update_index(now.where(kind != 0).select("repo", name.alias("path"), text.alias("content")), path)
    X.update_index(now, path)
    return X.index_report(X.stored_postings(spark, path))
