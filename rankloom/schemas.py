"""Schemas of the engine's inputs and outputs."""

from __future__ import annotations

RAW_PAPER = "paper_id string, title string, abstract string, paragraphs map<string,string>, _bad string"
PAPER_DOC = "doc_id string, title string, abstract string, year int, tokens array<string>"
PARAGRAPH_DOC = "doc_id string, paper_id string, text string, tokens array<string>"
PARAGRAPH_TEXT = "doc_id string, paper_id string, title string, text string"
PAPER_METADATA = "doc_id string, title string, abstract string, year int"
QUERY = "query_id string, query string, label string"
QREL = "query_id string, iter string, doc_id string, grade int"
RUN = "query_id string, q0 string, doc_id string, rank int, score double, run_id string"
TRAINING_EXAMPLE = "query_id string, query string, label string, positives map<string,int>, negatives array<string>"
TUNING_GRID = "k1 double, b double, metric double, seconds double"
LOSS_LOG = "step long, epoch double, split string, loss double"
HISTORY_ENTRY = "id string, query string, searchedAt timestamp"
SAVED_COLLECTION = "id string, name string, documents array<struct<id:string,result:string,searchCollection:string,sampleData:boolean,savedAt:timestamp>>"
