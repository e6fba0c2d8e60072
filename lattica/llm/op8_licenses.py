"""Licence scans: Aho-Corasick for tags and notice phrases, a shunting-yard for licence expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import binary_views, table, text_of

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases and the labels they add.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "licensed under the apache license": "apache",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# Identifier prefixes of expressions, their labels, and whether they permit free reuse.
FAMILIES = {"mit": ("mit", True), "apache": ("apache", True), "bsd": ("bsd", True), "isc": ("isc", True), "zlib": ("zlib", True), "unlicense": ("public-domain", True), "cc0": ("public-domain", True), "cc-by-nc": ("cc-by-nc", False), "cc-by-sa": ("cc-by-sa", False), "cc-by-nd": ("cc-by-nd", False), "cc-by": ("cc-by", True), "gpl": ("gpl", False), "lgpl": ("lgpl", False), "agpl": ("agpl", False), "mpl": ("mpl", False), "epl": ("epl", False)}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
TAG_TEXT = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def family(identifier: str) -> tuple[str, bool]:
    name = identifier.lower()
    for prefix in sorted(FAMILIES, key=len, reverse=True):
        if name == prefix or name.startswith((prefix + "-", prefix + "+")):
            return FAMILIES[prefix]
    return name, False


def postfix(text: str) -> list[str]:
    """Shunting-yard: the longest well-formed expression at the start of ``text``, in postfix order."""
    out, ops, best, pos, want, depth = [], [], [], 0, True, 0
    while m := TOKEN.match(text, pos):
        token, word = m[1], m[1].lower()
        if want and token == "(":
            ops.append("(")
            depth += 1
        elif want and token != ")" and word not in PRECEDENCE:
            out.append(token)
            want = False
        elif not want and token == ")" and depth:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif not want and word in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[word]:
                out.append(ops.pop())
            ops.append(word)
            want = True
        else:
            break
        pos = m.end()
        if not want and not depth:
            best = out + ops[::-1]
    return best


def evaluate(expression: list[str]) -> tuple[set[str], bool]:
    """(labels, permits free reuse): ``or`` offers a choice, ``and`` binds to both, ``with``
    adds an exception to its left side and keeps that side's label."""
    stack: list[tuple[set[str], bool]] = []
    for token in expression:
        if token in PRECEDENCE and len(stack) > 1:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            stack.append({"or": (a | b, free_a or free_b), "and": (a | b, free_a and free_b), "with": (a, free_a)}[token])
        else:
            label, free = family(token)
            stack.append(({label}, free))
    return stack[-1] if stack else (set(), False)


def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan(raw: bytes, machine) -> tuple:
    words = raw.translate(WORD_BYTES).split()
    text = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base, more, n_notices, tags = [], set(), set(), 0, False
    at, before = 0, 0  # how many words begin before place ``at``
    for end, phrase in machine.iter(text):
        if phrase in BASE:
            place = end - len(phrase)  # a longer phrase may begin before the last one
            before += text.count(" ", at, place) if place >= at else -text.count(" ", place, at)
            at = place
            starts.append(before - 1)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags = True
        else:
            more.add(NOTICES[phrase])
            n_notices += 1
    free, n_tags = None, 0
    if tags:
        for m in TAG_TEXT.finditer(raw.decode("utf-8", "replace")):
            if expression := postfix(m[1]):
                labels, ok = evaluate(expression)
                more |= labels
                free, n_tags = ok and free is not False, n_tags + 1
    score = 1.0 - 0.5 ** (len(starts) + n_notices + 2 * n_tags)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, free


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence findings of every whole text, one row per row of ``docs``, in one pass.

    Null and empty texts have no words and no labels; null doc_ids and repeated rows are
    kept; other columns are ignored; an empty table gives no rows. ``labels`` adds to the
    base labels those of further notices and of SPDX tags, whose expressions are parsed and
    evaluated; ``permissive`` is null without a tag. ``score`` is 1 - 2**-evidence, where a
    phrase counts 1 and a tag 2.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]

    def run(batches):
        machine = automaton()
        for batch in batches:
            found = [scan(bytes(v), machine) for v in binary_views(batch.column("text"))]
            columns = list(zip(*found)) if found else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES, ORACLE_SQL = {"op8_licenses": op8_licenses}, {}
