"""Schemas of the corpus tables and of the raw inputs, as DDL."""

from __future__ import annotations

SPANS = "array<struct<start:int,end:int>>"

DOC = "doc_id bigint, dir_id string, file string"
SENT = (
    f"doc_id bigint, six int, sid string, lang string, sent string, spans {SPANS}, toklen int"
)
CORP_DOC = "doc_id bigint, sid bigint, name string, file string"
CORP_SRC = "id string, name string, url string"

SENT_COLUMNS = ["doc_id", "six", "sid", "lang", "sent", "spans", "toklen"]

TABLES = {"doc": DOC, "sent": SENT, "corp_doc": CORP_DOC, "corp_src": CORP_SRC}

CRAWL = (
    "content string, metadata struct<quality_warnings:array<string>,"
    "sentence_identifications:array<struct<label:string,prob:double>>>"
)
TOK_XML = "_id string, w array<string>, _corrupt string"
SENT_XML = "_id string, _VALUE string, _corrupt string"
WIKI_PAGE = (
    "id bigint, title string, "
    "revision struct<text:struct<_bytes:bigint,_VALUE:string>>, _corrupt string"
)
REVIEWS = "text string, label string, topic string, emotion string"
ANNOTATIONS = (
    "a1_topic string, a2_topic string, a1_emotion string, a2_emotion string, "
    "a1_label int, a2_label int, notes string"
)
DATASET = "text string"
