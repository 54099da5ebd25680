"""License scans with a positional index of rare template words.

A pass over all documents counts, for each template word, the documents that
hold it. Each template's ANCHORS rarest words (highest IDF) enter the index
with their positions in the template. A file's occurrences of indexed words
vote for (template, place where the template would begin); a place with votes
from enough different anchors is checked: every mandatory key phrase must
stand where the template has it, and the score is the part of the template's
words that stand at their relative positions.

Apart from that, each place of a base phrase is counted exactly.

Defined results: null or empty text has 0 words, no labels, score 0 and null
places. A document may carry many labels. Overlapping places all count.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, texts_of

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licences, and the phrases that a match must hold.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use", "source and binary forms"],
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "with or without fee"],
    ),
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ["free of charge to any person", "obtaining a copy"],
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
}
#: Rarest words of a template that are indexed, and anchors that must agree on a place.
ANCHORS, AGREE = 4, 2
#: Least part of a template's words in place.
LEAST_COVER = 0.6

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCAN_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]

    @classmethod
    def of(cls, label: str, text: str, phrases: list[str]) -> Template:
        words, kept = words_of(text), []
        for p in map(words_of, phrases):
            at = next((i for i in range(len(words)) if words[i : i + len(p)] == p), None)
            if at is None:
                raise ValueError(f"{label}: a mandatory phrase is not part of the template")
            kept.append((at, p))
        return cls(label, words, kept)


class Scanner:
    """The index for one set of templates; df: documents holding each template word, of n_docs."""

    def __init__(self, templates: dict, base: dict, df: dict[bytes, int], n_docs: int) -> None:
        self.templates = [Template.of(k, *v) for k, v in sorted(templates.items())]
        self.base = [(words_of(p), label) for p, label in sorted(base.items())]
        self.heads: dict[bytes, list[int]] = defaultdict(list)
        for k, (p, _) in enumerate(self.base):
            self.heads[p[0]].append(k)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for t, template in enumerate(self.templates):
            idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in set(template.words)}
            rare = sorted(idf, key=lambda w: (-idf[w], w))[:ANCHORS]
            self.need.append(min(AGREE, len(rare)))
            for at, w in enumerate(template.words):
                if w in rare:
                    self.postings[w].append((t, at))
        self.wanted = frozenset(self.heads) | frozenset(self.postings)

    def matches(self, words: list[bytes], hits: list[int]) -> dict[str, tuple[float, int]]:
        """By label the best (cover, place) of its template."""
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for i in hits:
            for t, at in self.postings.get(words[i], ()):
                votes[t, i - at].add(words[i])
        best: dict[str, tuple[float, int]] = {}
        for (t, start), seen in sorted(votes.items()):
            template = self.templates[t]
            if len(seen) < self.need[t] or any(
                start + at < 0 or words[start + at : start + at + len(p)] != p for at, p in template.phrases
            ):
                continue
            there = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template.words))
            cover = there / len(template.words)
            if cover >= LEAST_COVER and cover > best.get(template.label, (0.0, 0))[0]:
                best[template.label] = (cover, start)
        return best

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        wanted = self.wanted
        hits = [i for i, w in enumerate(words) if w in wanted]
        places: list[int] = []
        labels: set[str] = set()
        for i in hits:
            for k in self.heads.get(words[i], ()):
                p, label = self.base[k]
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        found = self.matches(words, hits) if hits else {}
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | set(found))),
            "score": max((c for c, _ in found.values()), default=0.0),
        }


def template_words(templates: dict = TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for text, _ in templates.values() for w in words_of(text))


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents holding each vocabulary word, over all rows, and their number; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen[b""] += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(seen.values(), pa.int64())})

    rows = map_batches(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan_licences(docs: DataFrame, templates: dict = TEMPLATES, base: dict = BASE_PHRASES) -> DataFrame:
    """doc_id and the scan's columns, a row for each row of docs."""
    df, n = document_counts(docs, template_words(templates))
    scanner = Scanner(templates, base, df, n)
    names = [x.split()[0] for x in SCAN_SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.scan(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)]], ["doc_id", *names]
            )

    return map_batches(docs.select("doc_id", "text"), scan, f"doc_id long, {SCAN_SCHEMA}")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels, places and scores of every whole text."""
    return scan_licences(documents(spark, sf_dir))
