"""Operator 13, licence scans by ordered signature rules.

A text's words (letters, digits and what lies beyond ASCII, A-Z lower-cased) are
joined by one space. Rules (``license_rules``) are regular expressions over that
form. Method: a rule is tried only on texts that have all its keywords; the
spans that rules find are then thinned, as a span that lies inside one of a
rule of the same or a higher priority says nothing more: of two spans, the one
of the more certain class wins, then the wider one, then the rule that comes
first. What is left gives the labels, and the most certain class the score.

Base phrases are counted apart and their labels always stay.

Defined cases: a NULL or empty text has no words, no labels and score 0; rows
are read one by one, so repeated rows get equal results; spans of equal place
and class go to the earlier rule. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm import license_rules
from tipscope.llm.base import ship

ship(__name__)
ship(license_rules.__name__)

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A-Z to lower case; every other ASCII character but digits and a-z ends a word.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
               for c in range(256))
FOUND = "array<struct<label:string,class:string,start:long,stop:long>>"
FIELDS = ("id {0}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          f"found {FOUND}")


def thinned(spans: list[tuple[int, int, int, int]], classes: int) -> list[tuple[int, int, int, int]]:
    """Spans (start, stop, class, rule) that lie inside none that wins over them.
    Sorted so that what holds a span comes before it; the furthest stop of each
    class is all that need be known of those."""
    furthest, kept = [-1] * classes, []
    for span in sorted(spans, key=lambda s: (s[0], -s[1], s[2], s[3])):
        _, stop, kind, _ = span
        if max(furthest[:kind + 1]) < stop:
            kept.append(span)
            furthest[kind] = stop
    return kept


class Scanner:
    """Rules by their first keyword, compiled when first needed."""

    def __init__(self, rules=None):
        self.rules = list(rules or license_rules.rules())
        self.classes = list(license_rules.CLASSES)
        self.by_word: dict[bytes, list[int]] = {}
        self.needs = []
        for i, (_, _, keywords, _) in enumerate(self.rules):
            need = [k.encode() for k in keywords]
            self.by_word.setdefault(need[0], []).append(i)
            self.needs.append(need[1:])
        self.gate = frozenset(self.by_word)
        self.compiled: dict[int, re.Pattern] = {}

    def spans(self, form: bytes, words: set[bytes]):
        """What the gated rules find: (start, stop, class, rule)."""
        out = []
        for word in self.gate & words:
            for i in self.by_word[word]:
                if all(k in words for k in self.needs[i]):
                    if i not in self.compiled:
                        self.compiled[i] = re.compile(rf" (?:{self.rules[i][3]})(?= )".encode())
                    kind = self.classes.index(self.rules[i][0])
                    out += [(m.start(), m.end(), kind, i) for m in self.compiled[i].finditer(form)]
        return out

    def scan(self, text: str | None):
        """n_words, the number of base places, the first and last one's word, base
        labels and the spans that are left as (label, class, first word, last + 1)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
        form = b" " + b" ".join(words) + b" "
        first, last, n_base, base = [], [], 0, []
        for phrase, label in BASE.items():
            p = f" {phrase} ".encode()
            at = form.find(p)
            if at >= 0:
                first.append(at)
                last.append(form.rfind(p))
                base.append(label)
            while at >= 0:
                n_base += 1
                at = form.find(p, at + 1)
        found, at, word = [], 0, 0
        for start, stop, kind, i in thinned(self.spans(form, set(words)), len(self.classes)):
            word += form.count(b" ", at, start)  # spans come by start
            at = start
            found.append({"label": self.rules[i][1], "class": self.classes[kind], "start": word,
                          "stop": word + form.count(b" ", start, stop)})
        return (len(words), n_base, form.count(b" ", 0, min(first)) if first else None,
                form.count(b" ", 0, max(last)) if last else None, sorted(base), found)


def _scan(names):
    def run(batches):
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct(
            [("label", pa.string()), ("class", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]
        for b in batches:
            rows = [scanner.scan(t.as_py()) for t in b.column(1)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)
    return run


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word,
    base_labels, and ``found``: label, class and words of each span that is left."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found"]
    return rows.mapInArrow(_scan(names), FIELDS.format(rows.schema["id"].dataType.simpleString()))


def report(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    d = detect(docs)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda x: x["label"]))))
    sure = F.array_max(F.transform("found", lambda x: F.element_at(
        F.create_map(*[F.lit(v) for kv in license_rules.CLASSES.items() for v in kv]), x["class"])))
    return d.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                    F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                    F.coalesce(sure, F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"))
