"""Personal data and the terms that give it away: patterns, then corpus co-occurrence.

Base spans (email, ip, card, phone) come from patterns. A protected entity is the value of such a span. Terms that
stand near it in several contexts may tell it as well as the span itself: with df documents that hold term t,
c of them near entity e, P(e | t) = c / df, and seeing t leaves -log2 P(e | t) bits of what there is to know of
e. A term that leaves fewer bits than a threshold is disclosing. It is generalised to the class of words with
its first letters if the class leaves enough bits, else removed. Counts are over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_KEYS, fresh, materialize, maybe_broadcast, scratch, values, without
from cuelake.llm.lexical import TERM_BYTES, term_slices

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of a span that count as near it; contexts in which a term must stand near an entity;
#: P(e | t) of a disclosing term at least: it leaves at most 0.15 bits.
NEAR, CONTEXTS, SHARE = 8, 3, 0.9
#: Bytes of a word that name its class, and terms whose counts a task holds before it hands them on.
CLASS_BYTES, HELD_TERMS = 4, 1 << 18
MASKS = {kind: f"[{kind.upper()}]" for kind in KINDS[:-1]} | {"term": "*"}

LOCAL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
OTHER = re.compile(r"[^0-9]+")
TERM = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
SPANS = "array<struct<kind:string,start:int,end:int,mask:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("mask", pa.string())]))


def emails(text: str):
    """A match needs an @, and its local part lies between that and the @ or match before: each letter is read
    once, however long a run without @ is."""
    at, lo = text.find("@"), 0
    while at >= 0:
        start = lo + len(text[lo:at].rstrip(LOCAL))
        host = DOMAIN.match(text, at + 1) if start < at else None
        lo = host.end() if host else at + 1
        if host:
            yield start, lo
        at = text.find("@", lo)


def addresses(text: str):
    """Of a chain of numbers with dots each four are a match, kept if none is over 255."""
    for chain in DOTTED.finditer(text) if "." in text else ():
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(bare) <= 3 and int(bare or 0) <= 255 for bare in (p.lstrip("0") for p in four)):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    doubled = (d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return sum(doubled) % 10 == 0


def cards(text: str):
    for m in DIGITS.finditer(text):
        digits = OTHER.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in DIALLED.finditer(text) if "+" in text else ():
        if 8 <= len(OTHER.sub("", m[0])) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in their order, then by start."""
    return [(kind, *span) for kind, find in FINDERS.items() for span in find(text or "")]


def _signed(raw: bytes, seed: int) -> int:
    code = xxhash.xxh64_intdigest(raw, seed)
    return code - (code >> 63 << 64)


def term_code(word: bytes) -> int:
    return _signed(word, 42)


def class_code(word: bytes) -> int:
    return _signed(word[:CLASS_BYTES], 43)


def _entity(kind: str, value: str) -> int:
    return _signed(f"{kind}:{value.lower() if kind in ('email', 'ip') else OTHER.sub('', value)}".encode(), 44)


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, word) of the terms that no span touches."""
    taken, out, k = sorted((a, b) for _, a, b in spans), [], 0
    reach = 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][1]), k + 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m[0].encode().translate(TERM_BYTES)))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int]], near: int) -> dict[tuple[int, int, int], int]:
    """{(entity, term or class, its class or 0): context} of one text."""
    found: dict[tuple[int, int, int], int] = {}
    terms = free_terms(text, spans)
    starts = [t[0] for t in terms]
    for kind, start, end in spans:
        k, entity = bisect_left(starts, start), _entity(kind, text[start:end])
        around = [w for _, _, w in terms[max(0, k - near) : k + near]]
        context = _signed(b" ".join(around), 45)
        for w in around:
            found.setdefault((entity, term_code(w), class_code(w)), context)
            found.setdefault((entity, class_code(w), 0), context)
    return found


def _counts(docs: DataFrame, near: int) -> DataFrame:
    """(entity, term, class, context, n): documents that hold a term or class of terms (no entity), and documents
    where it stands near an entity."""

    def count(batches):
        held, classes, nears = Counter(), Counter(), Counter()

        def flush():
            rows = [(None, term_code(w), 0, 0, n) for w, n in held.items()] + [(None, _signed(w, 43), 0, 0, n) for w, n in classes.items()]
            rows += [(*key, context, n) for (key, context), n in nears.items()]
            for counts in (held, classes, nears):
                counts.clear()
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entity", "term", "class", "context", "n"])

        for batch in batches:
            for text in values(batch.column(0)):
                if not text:
                    continue
                words = set().union(*term_slices(text))
                held.update(words)
                classes.update({w[:CLASS_BYTES] for w in words})
                if spans := base_spans(text):
                    nears.update(near_terms(text, spans, near).items())
                if len(held) + len(nears) > HELD_TERMS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "entity long, term long, class long, context long, n long")


def disclosing_terms(docs: DataFrame, text_col: str = "text", near: int = NEAR, contexts: int = CONTEXTS, share: float = SHARE) -> DataFrame:
    """(term, entity, near_docs, docs, bits, generalise): the terms that give an entity away.

    ``term`` and ``entity`` are hashes (words of any length and values are not kept). A term is disclosing if it
    stands near the entity in at least ``contexts`` different contexts and at least ``share`` of the documents
    that hold it have it near that entity; ``bits`` is what it leaves, -log2 of that share. ``generalise`` is
    whether the class of its first letters stays under the share for every entity that the term tells.
    """
    with scratch(docs.sparkSession):
        return materialize(_disclosing(docs.select(F.col(text_col).alias("text")), near, contexts, share), "disclosing", keep=True)


def _disclosing(docs: DataFrame, near: int, contexts: int, share: float) -> DataFrame:
    counts = materialize(_counts(docs, near), "term-counts")
    # a common entity or term is summed inside tasks, then by context, then as a whole
    pairs = counts.where("entity is not null").groupBy("entity", "term", "class", "context").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "term", "class").agg(F.sum("n").alias("near_docs"), F.count("*").alias("contexts"))
    pairs = materialize(pairs.where(F.col("contexts") >= contexts), "near-terms")
    df = counts.where("entity is null").groupBy("term").agg(F.sum("n").alias("docs"))
    told = materialize(pairs.join(df, "term").where(F.col("near_docs") >= F.lit(share) * F.col("docs")), "told")
    wide = told.where("class = 0").select("entity", F.col("term").alias("class"), F.lit(True).alias("wide"))
    own = told.where("class <> 0").join(wide, ["entity", "class"], "left")
    bits = F.log2(F.col("docs") / F.col("near_docs"))
    return own.select("term", "entity", "near_docs", "docs", bits.alias("bits"), F.col("wide").isNull().alias("generalise"))


def marked(text: str | None, known: dict[int, bool]) -> list[dict]:
    """All spans of a text: base ones, then the terms in ``known`` (whether to generalise) that no base span
    touches. ``mask`` is what a span's text becomes."""
    spans = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "mask": MASKS[k]} for k, a, b in spans]
    if known and any(term_code(w) in known for part in term_slices(text) for w in set(part)):
        for a, b, w in free_terms(text, spans):
            soft = known.get(term_code(w))
            if soft is not None:
                out.append({"kind": "term", "start": a, "end": b, "mask": (w[:CLASS_BYTES].decode(errors="ignore") if soft else "") + MASKS["term"]})
    return out


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span's mask in its place; of spans that overlap the first one's mask stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], s["mask"]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _known_to_texts(docs: DataFrame, text_col: str, actions: DataFrame) -> DataFrame:
    """(t1, t2, known): for each text, by hash, the disclosing terms that it holds."""

    @F.arrow_udf("array<long>")
    def codes(texts: pa.Array) -> pa.Array:
        return pa.array([list({term_code(w) for part in term_slices(t) for w in part}) for t in values(texts)], pa.list_(pa.int64()))

    texts = docs.select(*[k.alias(n) for k, n in zip(_keys(text_col), ("t1", "t2"))], F.explode(codes(F.col(text_col))).alias("term")).distinct()
    return texts.join(actions, "term").groupBy("t1", "t2").agg(F.collect_list(F.struct("term", "generalise")).alias("known"))


def _keys(text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))


def personal_data(docs: DataFrame, text_col: str = "text", near: int = NEAR, contexts: int = CONTEXTS, share: float = SHARE) -> DataFrame:
    """docs with ``spans`` added: array of (kind, start, end, mask), code points, end exclusive, by kind in the
    order of KINDS, then by start.

    Base kinds, each by leftmost matches that do not overlap: e-mail addresses, IPv4 addresses (parts at most
    255), card numbers (16 to 19 digits that pass Luhn's test), phone numbers (a plus and 8 to 15 digits); a
    match that fails its test is dropped and not tried again. Spans of kind ``term`` are the words that the
    corpus shows to give an entity away (see ``disclosing_terms``), wherever they stand outside base spans. Null
    and empty texts have no spans, repeated rows count each time and get equal spans, columns named spans are
    replaced, an empty table stays empty.
    """
    docs = without(docs, *({"spans"} - {text_col}))
    t1, t2, known = fresh(docs, "t1", "t2", "known")
    spark = docs.sparkSession
    with scratch(spark):
        terms = materialize(_disclosing(docs.select(F.col(text_col).alias("text")), near, contexts, share), "disclosing")
        actions = materialize(terms.groupBy("term").agg(F.min("generalise").alias("generalise")), "actions")
        few = actions.count() <= BROADCAST_KEYS
        held = spark.sparkContext.broadcast({r["term"]: r["generalise"] for r in actions.collect()} if few else {})
        told = None if few else materialize(_known_to_texts(docs, text_col, actions), "known", keep=True)

    @F.arrow_udf(SPANS)
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array([marked(t, held.value) for t in values(texts)], _SPAN)

    @F.arrow_udf(SPANS)
    def mark_by(texts: pa.Array, terms: pa.Array) -> pa.Array:
        rows = zip(values(texts), terms)
        return pa.array([marked(t, {x["term"]: x["generalise"] for x in own.as_py() or ()}) for t, own in rows], _SPAN)

    if few:
        return docs.withColumn("spans", mark(F.col(text_col)))
    keyed = docs.withColumns(dict(zip((t1, t2), _keys(text_col)))).join(maybe_broadcast(told.toDF(t1, t2, known)), [t1, t2], "left")
    return keyed.withColumn("spans", mark_by(F.col(text_col), F.col(known))).drop(t1, t2, known)


def sanitise(docs: DataFrame, text_col: str = "text", near: int = NEAR, contexts: int = CONTEXTS, share: float = SHARE) -> DataFrame:
    """``personal_data`` with ``sanitised`` added: base spans become their kind in brackets, disclosing terms the
    first letters of their class or nothing but the mark ``*``. Null texts stay null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if t is None else masked(t, own.as_py()) for t, own in zip(values(texts), spans)], pa.string())

    found = personal_data(without(docs, *({"sanitised"} - {text_col})), text_col, near, contexts, share)
    return found.withColumn("sanitised", clean(F.col(text_col), F.col("spans")))
