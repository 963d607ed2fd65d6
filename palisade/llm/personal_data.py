"""Personal data and the terms that give it away, in DataFrame functions alone.

E-mail addresses, IP addresses, payment cards and phone numbers are the protected
entities. For every term that stands near one, corpus counts over all documents
estimate how much the term reveals: the pointwise mutual information of term and
entity, as a share of the information in the entity itself (1: whoever knows the
term knows the entity). Terms above GENERALISE become a class name, above REMOVE
they go, wherever they stand and in whichever document. A pair needs MIN_CONTEXTS
different contexts, so that copies of one mention are not taken for a pattern; how
often term and entity occur, alone and together, is counted by document.

Defined results: a null text is empty and has no spans; equal texts get equal
spans; rows are never merged or dropped; an empty table gives an empty result;
input columns named like a result column are replaced. Positions are code points,
the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh, guarded, let, set_aside, text_of, without, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")
#: The base patterns, written so that Java's engine neither backtracks nor recurses on
#: long runs: a match begins a run of its first class (or ends the match before it),
#: and repeats are possessive where giving back can't help. Cards: 14 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched for a kind at all.
MARKERS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){14}", "phone": r"\+[0-9]"}
#: Characters on either side of an entity that are its context, and the terms in it.
CONTEXT = 80
BLOCK = 1024
TERM = r"\p{L}{4,}"
MIN_CONTEXTS = 2
GENERALISE, REMOVE = 0.8, 0.95
SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"
RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")


def scanned(items: Column, zero: Column, step, kind: str) -> Column:
    """array<kind> of what step makes of each item: step(state, item) is (next state, output); zero the first state.

    Outputs are put together in about as many blocks as a block has items, since an array that grows
    is copied at each step."""
    empty = lambda kind: F.expr(f"cast(array() as {kind})")

    def add(done: Column, item: Column) -> Column:
        state, output = step(done["state"], item)
        return F.struct(state.alias("state"), F.concat(done["found"], F.array(output)).alias("found"))

    def add_block(done: Column, block: Column) -> Column:
        none = F.struct(done["state"].alias("state"), empty(f"array<{kind}>").alias("found"))
        return F.aggregate(
            block, none, add, lambda inner: F.struct(inner["state"].alias("state"), F.concat(done["blocks"], F.array(inner["found"])).alias("blocks"))
        )

    def in_blocks(items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / width).cast("int")), lambda k: F.slice(items, k * width + 1, width))
        none = F.struct(zero.alias("state"), empty(f"array<array<{kind}>>").alias("blocks"))
        return F.aggregate(blocks, none, add_block, lambda done: F.flatten(done["blocks"]))

    return let(items, in_blocks)


def placed(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match, in order: the lengths of the matches and of what lies between add up."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(values, lambda v: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(v)).alias("gap"), v.alias("value")))

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.char_length(pair["gap"])
        end = start + F.char_length(pair["value"])
        return end, F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))

    return scanned(pairs, F.lit(0), add, "struct<start:int,end:int,value:string>")


def _cut(text: Column) -> Column:
    """text in blocks of BLOCK characters, so that what lies far behind is found without counting up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _short(blocks: str, start: Column, length: Column) -> Column:
    """At most BLOCK characters from start on, out of _cut blocks."""
    block = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, block), F.lit("")), F.coalesce(F.get(blocks, block + 1), F.lit("")))
    return F.substring(two, start - block * BLOCK + 1, length)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, out of _cut blocks: in time of their number, wherever they lie."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda part: F.char_length(F.ltrim(part, F.lit("0"))) <= 3
        small = lambda part: F.right(F.concat(F.lit("000"), part), F.lit(3)).cast("int") <= 255
        return F.forall(F.split(value, r"\."), lambda part: short(part) & small(part))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"))
        return F.when(text.rlike(MARKERS[kind]), F.transform(valid, span)).otherwise(F.expr(f"cast(array() as {SPANS})"))

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(BASE)]))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_id"), F.octet_length(text).alias("text_size")]


def _mentions(docs: DataFrame) -> DataFrame:
    """A row for each term near an entity, from the different texts of docs."""
    text = F.col("text")
    searched = docs.select(text_of().alias("text")).withColumn("found", base_spans(text))
    searched = guarded(searched, F.size("found") > 0).select(*_text_key(text), F.char_length("text").alias("n"), "found", _cut(text).alias("blocks"))
    rows = searched.select("text_id", "text_size", "n", "found", "blocks", F.posexplode("found").alias("i", "span"))
    # A context ends where the entities before and after it do.
    before = F.coalesce(F.get("found", F.col("i") - 1)["end"], F.lit(0))
    after = F.coalesce(F.get("found", F.col("i") + 1)["start"], F.col("n"))
    start, end = F.col("span.start"), F.col("span.end")
    left_from = F.greatest(F.least(before, start), start - CONTEXT)
    right_to = F.least(F.greatest(after, end), end + CONTEXT)
    contexts = rows.select(
        "text_id",
        "text_size",
        F.concat_ws(":", "span.rank", F.lower("span.value")).alias("entity"),
        left_from.alias("left_from"),
        end.alias("right_from"),
        _short("blocks", left_from, start - left_from).alias("left"),
        _short("blocks", end, right_to - end).alias("right"),
    )

    def terms(side: str, begin: str) -> Column:
        moved = lambda x: F.struct((x["start"] + F.col(begin)).alias("start"), (x["end"] + F.col(begin)).alias("end"), F.lower(x["value"]).alias("term"))
        return F.transform(placed(F.col(side), TERM), moved)

    near = F.concat(terms("left", "left_from"), terms("right", "right_from"))
    exploded = contexts.select("text_id", "text_size", "entity", F.xxhash64("left", "right").alias("context"), F.explode(near).alias("t"))
    # Copies of a text have the same rows: they are one from here on.
    return exploded.select("text_id", "text_size", "entity", "context", F.xxhash64("t.term").alias("term"), "t.start", "t.end").distinct()


def _terms(text: Column) -> Column:
    """The hashes of the different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))


def _entities(docs: DataFrame) -> DataFrame:
    """A row for each entity of each different text of docs."""
    text = F.col("text")
    held = docs.select(text_of().alias("text")).withColumn("found", base_spans(text))
    held = guarded(held, F.size("found") > 0).select(*_text_key(text), F.explode("found").alias("span"))
    return held.select("text_id", "text_size", F.concat_ws(":", "span.rank", F.lower("span.value")).alias("entity")).distinct()


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(text_id, text_size, extra): of each text with such terms the hashes and ranks of those that reveal an entity.

    A term is looked at if it stands near an entity in enough contexts; from there on it counts
    wherever it stands: n_pair are the documents that hold both, and no document keeps the term."""
    n = max(docs.count(), 1)
    key = ["text_id", "text_size"]
    # Documents are counted with copies; contexts without.
    texts = written(docs.select(*_text_key(text_of())).groupBy(*key).agg(F.count("*").alias("copies")))
    holders = written(_entities(docs))
    entities = holders.join(texts, key).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    contexts = _mentions(docs).select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_contexts"))
    supported = written(contexts.where(F.col("n_contexts") >= MIN_CONTEXTS).join(entities, "entity").select("entity", "term", "n_entity"))
    counts = docs.select(F.explode(_terms(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # No term is in more of an entity's documents than it is in documents: common terms can't get there.
    information = F.log(F.lit(float(n)) / F.col("n_entity"))
    most = F.log(F.lit(float(n)) / F.greatest("n_term", "n_entity"))
    able = supported.join(counts, "term").where(F.try_divide(most, information) >= GENERALISE - 1e-9)
    able = written(able)
    # Of all terms of all texts only these are kept: few, as each is about as rare as its entity.
    able_terms = able.select("term").distinct()
    standing = written(docs.select(*_text_key(text_of()), F.explode(_terms(text_of())).alias("term")).join(able_terms, "term", "left_semi").distinct())
    together = standing.join(able.select("entity", "term"), "term").join(holders, [*key, "entity"], "left_semi").join(texts, key)
    pairs = together.groupBy("entity", "term").agg(F.sum("copies").alias("n_pair"))
    revealed = F.log(F.col("n_pair") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity")))
    known = able.join(pairs, ["entity", "term"]).withColumn("share", F.try_divide(revealed, information)).where(F.col("share") >= GENERALISE)
    rank = F.when(F.col("share") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    ranked = known.groupBy("term").agg(F.max(rank).alias("rank"))
    return standing.join(ranked, "term").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("term", "rank"))).alias("extra"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with counts of the base kinds, base_spans and all spans: arrays of
    (start, rank, end), rank being the place of the kind in KINDS."""
    docs = without(docs, *RESULTS)
    text, found, text_id, text_size, extra = fresh(docs, "__text", "__found", "__text_id", "__text_size", "__extra")
    extras = written(disclosing_terms(docs)).toDF(text_id, text_size, extra)
    own_id, own_size = fresh(docs, "__own_id", "__own_size")
    hashes = _text_key(F.col(text))
    rows = docs.withColumn(text, text_of()).withColumn(own_id, hashes[0]).withColumn(own_size, hashes[1])
    rows = rows.join(extras, (F.col(own_id) == F.col(text_id)) & (F.col(own_size) == F.col(text_size)), "left")
    # The spans of a text's terms, before the text itself is dropped.
    more = F.transform(placed(F.col(text), TERM), lambda x: F.struct(x["start"].alias("start"), F.try_element_at(extra, F.xxhash64(F.lower(x["value"]))).alias("rank"), x["end"].alias("end")))
    more = F.filter(more, lambda x: x["rank"].isNotNull())
    rows = rows.withColumn(found, base_spans(F.col(text))).withColumn(extra, F.when(F.col(extra).isNotNull(), more)).drop(text)
    bare = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    count = lambda rank: F.size(F.filter(found, lambda x: x["rank"] == rank)).cast("long")
    counted = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *counted,
        bare.alias("base_spans"),
        F.when(F.col(extra).isNull(), bare).otherwise(F.sort_array(F.concat(bare, F.col(extra)))).alias("spans"),
    )


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind, or removed."""
    renamed, own = set_aside(docs, RESULTS)
    found = find_personal_data(renamed)
    text = text_of()
    names = F.array(*[F.lit("" if k == "removed" else "[TERM]" if k == "generalised" else f"[{k.upper()}]") for k in KINDS])

    def put(at: Column, span: Column) -> tuple[Column, Column]:
        """What is put for a span that begins in front of another's end goes with that one."""
        piece = F.struct(at.alias("from"), F.greatest(at, span["start"]).alias("to"), F.when(span["start"] >= at, F.get(names, span["rank"])).otherwise("").alias("new"))
        return F.greatest(at, span["end"]), piece

    def cleaned(blocks: Column) -> Column:
        pieces = scanned(F.col("spans"), F.lit(0), put, "struct<from:int,to:int,new:string>")
        parts = F.transform(pieces, lambda x: F.concat(_between(blocks, x["from"], x["to"]), x["new"]))
        last = F.array_max(F.col("spans.end"))
        return F.concat(F.array_join(parts, ""), _between(blocks, last, F.char_length(text)))

    clean = F.when(F.size("spans") > 0, let(_cut(text), cleaned)).otherwise(F.col("text"))
    length = F.char_length(clean).cast("long")
    now = {"text": clean}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars"))
    return found.select(*[now[c].alias(c) if c in now else x for c, x in zip(docs.columns, own)])
