"""Personal data: fixed patterns, and terms that give it away by the company they keep.

The patterns find the protected entities: e-mail addresses, IP numbers, payment
cards and telephone numbers.  How much a term reveals of an entity is estimated
from the corpus: c stands for "near the entity", within a few words of it, and

    IC(c) = -log2 p(c),   PMI(c; t) = log2(p(c | t) / p(c)),

with p(c) the share of all words that stand near the entity, and p(c | t) that of
the term's occurrences.  PMI / IC is 1 if the term stands nowhere else and 0 if it
tells nothing.  Terms beyond a threshold are generalised, beyond a higher one
removed, wherever they stand.  Copies of a text are one testimony: a term must
stand near the entity in several different surroundings, before it and behind it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices, unused

#: Kinds of the patterns, in the order of equal starts; that of the method follows.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Words of terms: letters, digits and all beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: Words before and behind an entity that count as near it.
NEAR = 5
#: Records that a task gathers before it sends them on.
_FLUSH = 100_000

_SPAN = "array<struct<kind:string,start:int,end:int,action:string>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("action", pa.string())]))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a search for the whole pattern from left to right, but outwards from each @: linear in any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches, by start and then kind.

    For each kind, matches are the leftmost that don't overlap; those that fail
    a test (parts up to 255, 12 to 19 digits and their check sum, 9 to 15
    digits) are dropped, and nothing is tried in their place.
    """
    found = [(start, end, 0) for start, end in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 2 * 19:  # a separator at most between two digits
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), 2))
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(start, end, KINDS[kind]) for start, end, kind in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def _lower(text: str) -> str:
    """A-Z in lower case; all places stay."""
    return text.encode().lower().decode()


def _words(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """``(word, start, end)`` of the words outside the spans."""
    out, at, reach = [], 0, 0
    for m in _WORD.finditer(_lower(text)):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if m.start() >= reach:
            out.append((m[0], m.start(), m.end()))
    return out


def _name(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _company(text: str, spans: list[tuple[int, int, str]], words: list[tuple[str, int, int]], near: int) -> Iterator[tuple[int, str, int, int, int]]:
    """``(entity, term, side, surroundings, n)``: terms near each entity.

    A place of a term counts once for an entity; the surroundings of both sides
    are named for each occurrence of it.
    """
    counted: set[tuple[int, int]] = set()
    behind = 0
    for start, end, kind in spans:
        entity = _name(kind, _lower(text[start:end]))
        while behind < len(words) and words[behind][1] < start:
            behind += 1
        sides = [words[max(0, behind - near) : behind], words[behind : behind + near]]
        names = [_name(*(w for w, _, _ in side)) for side in sides]
        for k in range(max(0, behind - near), min(len(words), behind + near)):
            fresh = (entity, k) not in counted
            counted.add((entity, k))
            yield entity, words[k][0], 0, names[0], int(fresh)
            yield entity, words[k][0], 1, names[1], 0


def _records(docs: DataFrame, near: int) -> DataFrame:
    """Counts of words (entity null) and of terms near entities, combined within a task."""

    def run(batches):
        words_seen: dict[str, int] = {}
        company: dict[tuple, int] = {}

        def rows():
            plain = [(None, w, None, None, n) for w, n in words_seen.items()]
            kinds = (pa.int64(), pa.string(), pa.int8(), pa.int64(), pa.int64())
            made = [*plain, *((*key, n) for key, n in company.items())]
            words_seen.clear()
            company.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["entity", "term", "side", "around", "n"])

        for batch in slices(batches, 64):
            for text in batch.column(0):
                text = text.as_py()
                if not text:
                    continue
                spans = base_spans(text)
                if spans:
                    words = _words(text, spans)
                    for *key, n in _company(text, spans, words, near):
                        key = tuple(key)
                        company[key] = company.get(key, 0) + n
                    found = [w for w, _, _ in words]
                else:
                    found = _WORD.findall(_lower(text))
                for word in found:
                    words_seen[word] = words_seen.get(word, 0) + 1
                if len(words_seen) + len(company) > _FLUSH:
                    yield rows()
        if words_seen or company:
            yield rows()

    return docs.mapInArrow(run, "entity bigint, term string, side tinyint, around bigint, n bigint")


def disclosing_terms(docs: DataFrame, *, text_col: str = "text", near: int = NEAR, surroundings: int = 3, generalise_at: float = 0.95, remove_at: float = 0.99) -> DataFrame:
    """``term, disclosure, action``: terms that reveal an entity, by co-occurrence over all texts.

    A term counts if it stands within ``near`` words of the entity in at least
    ``surroundings`` different texts before it and as many behind it.
    disclosure is the largest PMI / IC over entities; action is ``remove`` from
    ``remove_at`` on, else ``generalise``.  Null and empty texts say nothing; an
    empty table gives no terms.  The result is a written table.
    """
    records = saved(_records(docs.select(F.col(text_col).alias("text")), near))
    total = records.where(F.col("entity").isNull()).agg(F.sum("n")).first()[0] or 0
    counts = records.where(F.col("entity").isNull()).groupBy("term").agg(F.sum("n").alias("n"))
    company = records.where(F.col("entity").isNotNull())
    by_entity = company.groupBy("entity").agg(F.sum("n").alias("near_n"))
    places = company.groupBy("entity", "term", "side", "around").agg(F.sum("n").alias("n"))
    pairs = places.groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.sum(1 - F.col("side")).alias("before"), F.sum("side").alias("behind"))
    pairs = pairs.where((F.col("before") >= surroundings) & (F.col("behind") >= surroundings))
    prior = F.col("near_n") / F.lit(float(max(total, 1)))
    disclosure = F.log2((F.col("joint") / F.col("n")) / prior) / -F.log2(prior)
    # Where all words of the corpus stand near one entity it carries no information.
    scored = pairs.join(counts, "term").join(by_entity, "entity").where(prior < 1).select("term", disclosure.alias("disclosure"))
    worst = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    out = saved(worst.select("term", "disclosure", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")))
    discard(records)
    return out


#: Terms that a task may hold; beyond, texts are joined to their terms.
HELD_TERMS = 200_000


def _all_spans(text: str, actions: dict[str, str]) -> list[dict]:
    base = base_spans(text)
    made = [(start, KINDS.index(kind), end, kind, "mask") for start, end, kind in base]
    if actions and not actions.keys().isdisjoint(_WORD.findall(_lower(text))):
        made += [(start, len(KINDS), end, TERM, actions[word]) for word, start, end in _words(text, base) if word in actions]
    return [{"kind": kind, "start": start, "end": end, "action": action} for start, _, end, kind, action in sorted(made)]


def find_spans(docs: DataFrame, terms: DataFrame, *, text_col: str = "text", out: str = "spans", held_terms: int = HELD_TERMS) -> DataFrame:
    """The rows of docs with ``spans``: all places of personal data, by start and then kind.

    terms: as disclosing_terms gives them.  Places are code points, the end is
    exclusive; kinds are email, ip, card, phone (action mask) and term.  A null
    or empty text has none; other columns stay, one named ``out`` is replaced.
    Up to ``held_terms`` terms are sent to all tasks; with more of them, each
    text's own terms are joined to it.
    """
    columns = [c for c in docs.columns if c != out]
    source, spark = docs.select(*columns), docs.sparkSession
    own = unused("_tidemark_terms", source)
    if terms.limit(held_terms + 1).count() <= held_terms:
        shared = spark.sparkContext.broadcast({r.term: r.action for r in terms.collect()})
    else:
        shared = None
        key = unused("_tidemark_key", source)
        text = F.col(text_col)
        lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = F.array_distinct(F.split(lower, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"))
        # Equal texts have equal terms: they are joined by the text's digest.
        digest = F.sha2(text, 256)
        hits = source.where(text.isNotNull()).select(digest.alias(key), F.explode(words).alias("term")).join(terms.select("term", "action"), "term")
        per_text = hits.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias(own))
        source = source.withColumn(key, digest).join(per_text, key, "left").drop(key)

    def run(batches):
        held = shared.value if shared else {}
        for batch in slices(batches, 64):
            at = batch.schema.names.index(text_col)
            maps = batch.column(own).to_pylist() if shared is None else None
            spans = []
            for k, text in enumerate(batch.column(at)):
                text = text.as_py()
                spans.append(_all_spans(text, held if maps is None else dict(maps[k] or ())) if text else [])
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, _ARROW_SPAN)], names=[*columns, out])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*docs.select(*columns).schema.fields]).add(out, _parse_datatype_string(_SPAN))
    return source.mapInArrow(run, schema)


def _general(word: str) -> str:
    """What a term is replaced by when it is generalised: its kind."""
    return "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]"


def cleaned(text: str, spans: list) -> str:
    """The text without its personal data: each stretch of overlapping spans becomes the first one's mark."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            word = text[span["start"] : span["end"]]
            mark = f"[{span['kind']}]" if span["action"] == "mask" else _general(word) if span["action"] == "generalise" else ""
            out += [text[at : span["start"]], mark]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, text_col: str = "text", spans_col: str = "spans", **thresholds) -> DataFrame:
    """The rows of docs, their texts without personal data, with ``spans`` of what stood where.

    Patterns' matches are masked by their kind; terms that disclose too much are
    removed, or replaced by their kind of word.  Null texts stay null.  thresholds:
    those of disclosing_terms.
    """
    terms = disclosing_terms(docs, text_col=text_col, **thresholds)
    marked = find_spans(docs, terms, text_col=text_col, out=spans_col)

    def run(batches):
        for batch in slices(batches, 64):
            at = batch.schema.names.index(text_col)
            texts = [None if t is None else cleaned(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(at).type) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return marked.mapInArrow(run, marked.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``: what find_spans finds, counted and named."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_spans(source, disclosing_terms(source))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in (*KINDS, TERM)]
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *counts[:-1], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), counts[-1])
