"""Personal data, and terms that give it away, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The other words of
a document may reveal such a value as well. How strongly is estimated from the corpus:
with N documents, of which n_t hold the term, n_e the entity, and n_te both, the
disclosure is the pointwise mutual information log(N n_te / (n_t n_e)) as a share of the
entity's information log(N / n_e); 1 says that the term names the entity. Terms above one
threshold are generalised to their class, above a second one removed, wherever they stand
in a document that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Fixed values, in the order in which ties are listed: kind, pattern, what a text must hold for it.
#: Possessive quantifiers match the same and keep Java from recursing on long runs. A match
#: can only begin where a run of its first characters does, or where the match before ended:
#: the rest of a run fails as its beginning does, and isn't tried again at every character.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = "term"
#: Code points of the shortest term.
SHORTEST = 3
#: Documents that must hold term and entity together before a disclosure is believed.
SUPPORT = 3
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Values of a text that one fold collects; its square root of them, where there are many.
CHUNK = 64
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_TERM = "array<struct<start:int,end:int,disclosure:double>>"
_SPACE = r"[\x20\x09-\x0D]+"
#: Covers values while words are read; texts that hold it get the noncharacter before it.
_COVER, _OTHER = "\uffff", "\ufffe"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
        return F.forall(F.split(x, r"\."), lambda p: small(F.ltrim(p, F.lit("0"))))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _let(x: Column, then) -> Column:
    """then(x), where x is worked out once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _chunks(array: Column) -> Column:
    """An array as an array of arrays, each of CHUNK elements or of as many as there are chunks.

    A fold copies what it has collected at every step; folds over chunks, and one over
    their results, stay far below the square of an array's size.
    """
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(array).cast("double"))).cast("int"))
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(array, k, size))


def _laid_out(pairs: Column, kind: str, before, body, after, entry, good) -> Column:
    """The good ones of pairs that lie one behind the other, with where they start.

    before, body and after give a pair's lengths, entry(start, end, x) the element of
    type kind, good(x) whether it counts.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + before(x)
        end = start + body(x)
        return F.struct((end + after(x)).alias("at"), F.when(good(x), F.array_append(acc["out"], entry(start, end, x))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    folded = F.transform(_chunks(pairs), lambda c: F.aggregate(c, begin, step))
    moved = lambda c, by: F.transform(c["out"], lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(folded, outer, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["out"], moved(c, acc["at"])).alias("out")), lambda acc: acc["out"]))


def _found(text: Column, number: int) -> Column:
    """Spans of one kind, from what splits the text and what stands between."""
    kind, pattern, needs = KINDS[number]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))
    spans = _let(pairs, lambda p: _laid_out(
        p, _SPAN, lambda x: F.length(x["gap"]), lambda x: F.coalesce(F.length(x["value"]), F.lit(0)), lambda x: F.lit(0),
        lambda start, end, x: F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value")),
        lambda x: x["value"].isNotNull() & _valid(kind, x["value"]),
    ))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast(_SPAN))


def _rewritten(text: Column, spans: Column, new) -> Column:
    """text with new(span, value, width) for each span of spans, sorted by start; what lies in two spans belongs to the first.

    value is what the span covers of the text and width its code points that no span
    before covers.
    """

    def pieces(part: Column, at: Column, c: Column) -> Column:
        """A chunk's part of the text, which begins at at."""

        def step(acc: Column, s: Column) -> Column:
            start, end = F.greatest(acc["at"], s["start"] - at), F.greatest(acc["at"], s["end"] - at)
            value = F.substring(part, s["start"] - at + 1, s["end"] - s["start"])
            parts = F.array(F.substring(part, acc["at"] + 1, start - acc["at"]), new(s, value, end - start))
            return F.struct(end.alias("at"), F.concat(acc["out"], parts).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(c, begin, step, lambda acc: F.array_join(acc["out"], ""))

    def outer(acc: Column, c: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(c, lambda s: s["end"])))
        part = _let(F.substring(text, acc["at"] + 1, end - acc["at"]), lambda p: pieces(p, acc["at"], c))
        return F.struct(end.alias("at"), F.array_append(acc["out"], part).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(_chunks(spans), begin, outer, rest)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> by start and kind, in code points, end exclusive."""
    return F.sort_array(F.concat(*[_found(text, k) for k in range(len(KINDS))]))


def _clean(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _words(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(_COVER), F.lit(_OTHER)), _SPACE, -1)


def _covered(text: Column, spans: Column) -> Column:
    """text with every code point of its spans covered; positions stay."""
    cover = lambda s, value, width: F.repeat(F.lit(_COVER), width)
    return _let(F.replace(text, F.lit(_COVER), F.lit(_OTHER)), lambda t: _rewritten(t, spans, cover))


def _open(word: Column) -> Column:
    """Whether a word of a covered text is a term."""
    return ~F.contains(word, F.lit(_COVER)) & (F.length(_clean(word)) >= SHORTEST)


def _places(covered: Column, known: Column) -> Column:
    """Where the terms of the map known stand: array<struct<start, end, disclosure>>."""
    share = lambda x: F.try_element_at(known, _clean(x["word"]))
    pairs = F.arrays_zip(F.split(covered, _SPACE, -1).alias("word"), F.regexp_extract_all(covered, F.lit(_SPACE), F.lit(0)).alias("gap"))
    return _let(pairs, lambda p: _laid_out(
        p, _TERM, lambda x: F.lit(0), lambda x: F.length(x["word"]), lambda x: F.coalesce(F.length(x["gap"]), F.lit(0)),
        lambda start, end, x: F.struct(start.alias("start"), end.alias("end"), share(x).alias("disclosure")),
        lambda x: _open(x["word"]) & share(x).isNotNull(),
    ))


def _judged(held: DataFrame, total: int) -> DataFrame:
    """(row, judged, most): the classes of values that a document holds, of those that can be judged.

    Values that stand in the same documents disclose alike, and are one class: what tells
    classes apart is the number of documents and two hashes over them. However many
    values a text lists, it has no more classes than ways to share documents.
    """
    n_e = held.select("row", F.explode("entities").alias("entity"))
    facts = n_e.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(2))).alias("b"))
    facts = facts.where(F.col("n_e").between(SUPPORT, total - 1))
    most = F.lit(float(total)) * F.pow(F.col("n_e") / F.lit(float(max(total, 1))), F.lit(GENERALISE)) * (1 + 1e-9)
    classes = n_e.join(facts, "entity").select("row", F.struct("n_e", "a", "b").alias("class"), "n_e", most.alias("most")).distinct()
    return classes.groupBy("row").agg(F.collect_list(F.struct("class", "n_e", "most")).alias("judged"), F.max("most").alias("most"))


def _disclosing(held: DataFrame, judged: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(class, term, disclosure) of the pairs that reveal, from whole documents.

    held has the rows with values: row, entities and the covered text; words the words of
    all documents. As n_te is n_e at most, a term of more than N (n_e / N)^GENERALISE
    documents can't reach the threshold; such pairs are left out before they are counted.
    """
    top = judged.agg(F.max("most")).first()[0] or 0.0
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t").between(SUPPORT, int(top)))
    terms = F.array_distinct(F.transform(F.filter(F.split("covered", _SPACE, -1), _open), _clean))
    terms = held.join(judged, "row").select("judged", F.explode(terms).alias("term")).join(n_t, "term")
    pairs = terms.select("term", "n_t", F.explode(F.filter("judged", lambda e: F.col("n_t") <= e["most"])).alias("e"))
    pairs = pairs.groupBy("e.class", "term").agg(F.count("*").alias("n_te"), F.first("e.n_e").alias("n_e"), F.first("n_t").alias("n_t")).where(F.col("n_te") >= SUPPORT)
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return pairs.select("class", "term", (pmi / F.log(F.lit(float(total)) / F.col("n_e"))).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, terms: one row per row of docs.

    base has the base spans, terms those of revealing words with their disclosure. Both
    are found in every whole text; a null text is empty. Document counts are over all
    rows, so that repeated rows count each. Equal rows get equal spans. Other columns of
    docs are not read.
    """
    text = F.coalesce("text", F.lit(""))
    spans = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    covered = F.when(F.size("base") > 0, _covered(F.col("text"), F.col("base")))
    spans = stage_table(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "base", covered.alias("covered")), "spans")
    entities = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))))
    held = spans.where("covered is not null").select("row", entities.alias("entities"), "covered")
    words = docs.select(F.explode(F.array_distinct(F.transform(_words(text), _clean))).alias("term"))
    total = spans.count()
    judged = stage_table(_judged(held, total), "judged")
    known = stage_table(_disclosing(held, judged, words, total), "pairs")
    flagged = judged.select("row", F.explode("judged.class").alias("class")).join(known, "class").groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    flagged = flagged.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    placed = held.join(flagged, "row").select("row", _places(F.col("covered"), F.col("known")).alias("terms"))
    return spans.drop("covered").join(placed, "row", "left").select("doc_id", "text_hash", "base", F.coalesce("terms", F.array().cast(_TERM)).alias("terms"))


def counted(base: Column) -> list[Column]:
    """n_email, n_ip, n_card and n_phone of base spans."""
    #: A lambda's second parameter would be taken for the element's index, whatever its default.
    of_kind = lambda k: lambda s: s["kind"] == k
    return [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(TERM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def all_spans(base: Column, terms: Column) -> Column:
    """Base and term spans together, by start and kind: array<struct<start, kind, end, disclosure>>."""
    own = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure")))
    more = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), s["disclosure"].alias("disclosure")))
    return F.sort_array(F.concat(own, more))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts: values become their kind, terms their class or nothing.

    What overlapping spans cover goes; the first of them names it. A null text stays null; n_chars, if there, is
    counted anew where the text changed. All other columns pass through.
    """
    spans = find_spans(docs).select("doc_id", "text_hash", all_spans(F.col("base"), F.col("terms")).alias("spans"))
    spans = spans.where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    names = F.array(*[F.lit(f"[{k[0].upper()}]") for k in KINDS])

    def new(s: Column, value: Column, width: Column) -> Column:
        general = F.when(value.rlike("[0-9]"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
        kept = F.when(s["kind"] < len(KINDS), F.try_element_at(names, s["kind"] + 1)).when(s["disclosure"] < REMOVE, general).otherwise(F.lit(""))
        return F.when(width == s["end"] - s["start"], kept).otherwise(F.lit(""))

    #: One struct, so that no name of a column meets one of ours.
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    rows = docs.select(others, "text", F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    clean = F.when(F.col("spans").isNull() | F.col("text").isNull(), F.col("text")).otherwise(_rewritten(F.col("text"), F.col("spans"), new))
    joined = joined.select("others", "spans", clean.alias("clean"))
    out = {c: F.col(f"others.`{c}`") for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("spans").isNull(), F.col("others.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    out["text"] = F.col("clean").alias("text")
    return joined.select(*out.values())
