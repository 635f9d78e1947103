"""Explicit schemas of the reference's inputs (no inference on any reader)."""

from __future__ import annotations

CHUNK = "struct<id:string,text:string>"

EPISODE = (
    "title string, summary string, published_date string, audio_urls string, status string, "
    f"status_message string, text string, chunks array<{CHUNK}>"
)

GROUND_TRUTH = "id string, question string"

QUESTIONS = "questions array<string>"

FEED_ITEM = ("struct<title:string,description:string,pubDate:string,"
             "enclosure:array<struct<_url:string>>>")
FEED_CHANNEL = f"title string, item array<{FEED_ITEM}>"

ATOM_ENTRY = ("struct<title:string,summary:string,content:string,published:string,updated:string,"
              "link:array<struct<_rel:string,_href:string>>>")
ATOM_FEED = f"title string, entry array<{ATOM_ENTRY}>"

CATALOGUE = ("resultCount int, results array<struct<collectionId:string,collectionName:string,"
             "artistName:string,feedUrl:string>>")

TRANSCRIPT = f"chunks array<{CHUNK}>, text string"

DOCUMENT = "id string, text string, text_vector array<float>"

# a document's version: the largest wins, and a deleted one is gone
VERSIONED = "id string, text string, vector array<float>, version bigint, deleted boolean"

ENTITY = "label string, text string, score double"

CHAT_MESSAGE = "role string, content string"
