"""Named, parameterised SQL over the corpus tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_STAR = (
    "FROM corp_doc cd JOIN corp_src cs ON cs.id = cd.name JOIN doc d ON d.doc_id = cd.doc_id"
)
_DOC_SENTS = "(SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id)"

# The names of the statements.
NAMED: dict[str, str] = {
    "doc_count": "SELECT count(*) AS cnt FROM doc",
    "sent_count": "SELECT count(*) AS cnt FROM sent LEFT SEMI JOIN doc ON doc.doc_id = sent.doc_id",
    "corp_doc_count": "SELECT count(*) AS cnt FROM corp_doc",
    "corp_doc_name_count": "SELECT count(DISTINCT name) AS cnt FROM corp_doc",
    "select_doc_ids": "SELECT doc_id FROM doc",
    "select_doc_exists": "SELECT count(*) AS cnt FROM doc WHERE doc_id = ?",
    "select_corpus_source": (
        f"SELECT cs.name, cs.id, cd.file AS sub_path, d.dir_id AS directory_id, d.file {_STAR}"
    ),
    "select_doc": "SELECT doc_id, dir_id, file FROM doc",
    "select_corp_doc": "SELECT doc_id, sid, name, file FROM corp_doc",
    "select_corp_doc_names": "SELECT DISTINCT name FROM corp_doc ORDER BY name",
    "select_sent_by_doc_id": "SELECT sent, spans, sid, six FROM sent WHERE doc_id = ? ORDER BY six",
    "select_corp_doc_count_by_name": "SELECT name, count(name) AS cnt FROM corp_doc GROUP BY name",
    "select_corp_by_doc_count": (
        "SELECT name, min(doc_id) AS doc_id, count(name) AS cnt FROM corp_doc GROUP BY name"
    ),
    "select_sent_src": (
        "SELECT d.doc_id, cs.name, cs.url, d.file, s.six, s.sid, s.sent "
        f"{_STAR} JOIN sent s ON s.doc_id = d.doc_id ORDER BY cd.name, d.doc_id, s.six"
    ),
    "count_sent": "SELECT count(*) AS cnt FROM sent",
    "select_sent": "SELECT sent FROM sent WHERE doc_id = ? AND six = ?",
    "select_sent_ids": "SELECT doc_id, six FROM sent",
    "select_sents": "SELECT sent FROM sent ORDER BY doc_id, six LIMIT ?",
    "select_vocab": "SELECT token FROM vocab",
    "select_sent_count": "SELECT count(*) AS cnt FROM sent",
    "select_token_count": "SELECT sum(toklen) AS cnt FROM sent",
    "select_char_count": "SELECT sum(length(sent)) AS cnt FROM sent",
    "select_corpus_sources": (
        "SELECT cs.id AS name, min(cs.url) AS url, sum(s.n) AS count "
        f"{_STAR} JOIN {_DOC_SENTS} s ON s.doc_id = cd.doc_id GROUP BY cs.id"
    ),
}


#: Arguments that the queries of the catalog fill in.
EXAMPLES: dict[str, tuple] = {
    "select_doc_exists": (3,),
    "select_sent_by_doc_id": (3,),
    "select_sent": (3, 2),
    "select_sents": (500,),
}


def named_query(
    spark: SparkSession, name: str, args: Sequence | None = None, **tables: DataFrame
) -> DataFrame:
    """Runs a named query; ``args`` fill its ``?`` markers in order.

    Tables come from the session catalog, or from frames given by name, which
    leave no view behind.
    """
    views = {table: f"textloom_{uuid.uuid4().hex}" for table in tables}
    for table, df in tables.items():
        df.createOrReplaceTempView(views[table])
    given = ", ".join(f"{table} AS (SELECT * FROM {view})" for table, view in views.items())
    result = spark.sql(f"WITH {given} {NAMED[name]}" if given else NAMED[name], args=list(args or []))
    for view in views.values():
        spark.catalog.dropTempView(view)
    return result
