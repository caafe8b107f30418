"""Personal data by bootstrapped contextual extraction, in native expressions only.

Fixed patterns find seed entities. The two words before a mention are its lexical
pattern. Patterns and instances form a bipartite graph with an edge for each
occurrence: a pattern's score is the share of its mentions that are known, an
instance's is the noisy-or of its patterns' scores, and both are recomputed in
rounds, with patterns that reach ``CONFIDENT`` over at least ``SUPPORT`` distinct
known instances, seeds or discovered, making their identifier-like mentions known.
Scores only rise, and rounds end when none rises by more than ``STILL``. What is then
known beyond the seeds is found personal data, wherever it stands.

A regular expression's match positions come from splitting the text at it: the
pieces between matches and the matches alternate. Patterns use possessive
quantifiers, which take what the plain ones would and don't recurse, and start only
at a run's first character or where the last match ended.

What may be discovered is limited by definition: identifiers have 6 to 40 characters and
at least four digits, and a context is two words of 2 to 30 letters each, which with
what may stand between them take 67 characters at most. Others are left alone.

Defined results: null and empty texts have no spans. Offsets are code points, ends
exclusive. Repeated rows are searched alike; rows may repeat an id or have none. Spans
of one start go by kind. An empty table gives no row. ``find_personal_data`` reads doc_id
and text only; ``redact`` gives all columns back, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpointed

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "context"]
SUPPORT = 5
CONFIDENT = 0.8
STILL = 1e-6
#: Matches of a text are placed, and covered, in parts of this many.
PART = 256

# Fixed patterns. The groups are unrolled and possessive, the language is that of the plain form.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
#: Words of 6 to 40 characters with at least four digits may be identifiers.
IDENTIFIER = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9/_.-]{6,40}+(?![A-Za-z0-9]))(?:[A-Za-z/_.-]{0,36}[0-9]){4}[A-Za-z0-9/_.-]{0,36}(?<=[A-Za-z0-9])(?![A-Za-z0-9])"
LEFT = r"([\p{L}]{2,30})[^\p{L}\n]{1,3}([\p{L}]{2,30}[:#=]?)[\x20\"'(]{0,3}$"

_SPAN = "array<struct<kind:string,start:long,end:long,value:string,left:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what a lambda only refers to is worked out for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(array: Column) -> Column:
    """The array in parts of ``PART`` elements, so that arrays and strings that grow by copies stay short; one empty part for none."""
    return _let(array, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(a, i + 1, PART)))


def _before(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one, and before the end, come to."""
    return F.aggregate(values, F.array(zero), lambda acc, v: F.array_append(acc, add(F.element_at(acc, -1), v)))


def _positions(text: Column, pattern: str, kind: str, needs: Column) -> Column:
    """Every match of a pattern as (kind, start, end, value, left): left is the end of the text before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(found, F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    width = lambda x: F.char_length(x["gap"]) + F.char_length(x["value"])

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = acc["at"] + width(x)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(70)).alias("left"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def place(parts: Column) -> Column:
        widths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n + width(x)))
        begins = F.slice(_before(widths, F.lit(0).cast("long"), lambda n, w: n + w), 1, F.size(parts))
        placed = F.zip_with(parts, begins, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), add)["out"])
        return F.flatten(placed)

    # The last piece has no match after it.
    matches = F.filter(both, lambda x: x["value"].isNotNull())
    return F.when(needs, _let(_parts(matches), place)).otherwise(F.array().cast(_SPAN))


def _outside(words: Column, seeds: Column) -> Column:
    """The words that no seed touches: each part of the words meets the seeds of its stretch only."""
    apart = lambda w: lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])

    def free(part: Column) -> Column:
        stretch = F.struct(F.element_at(part, 1)["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"))
        near = _let(stretch, lambda r: F.filter(seeds, apart(r)))
        return _let(near, lambda n: F.filter(part, lambda w: ~F.exists(n, apart(w))))

    return F.flatten(F.transform(_parts(words), lambda p: F.when(F.size(p) > 0, free(p)).otherwise(p)))


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, (F.length(digits) - k).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card(s: Column) -> Column:
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    return _let(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))


def base_spans(text: Column) -> Column:
    """The seed entities of a text."""
    phone_digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.concat(
        _positions(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        F.filter(_positions(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda s: s["value"].rlike(IP_VALID)),
        F.filter(_positions(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), _card),
        F.filter(_positions(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: phone_digits(s).between(10, 15)),
    )


def _pattern(left: Column) -> Column:
    two = F.concat_ws(" ", F.regexp_extract(left, LEFT, 1), F.regexp_extract(left, LEFT, 2))
    return F.when(F.length(two) > 2, F.lower(two))


def mentions(docs: DataFrame) -> DataFrame:
    """uid, doc_id, of (a hash of the text), spans (seeds) and mentions (seeds and identifier-like words: known, start, end, value, pattern) of every row. Stored, so that uid holds."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("text")).withColumn("seeds", base_spans(F.col("text")))
    words = _positions(F.col("text"), IDENTIFIER, "context", F.col("text").rlike(r"[0-9][^\s]{0,36}[0-9]"))
    free = _outside(words, F.col("seeds"))
    strip = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    both = F.transform(F.concat("seeds", free), lambda s: F.struct((s["kind"] != "context").alias("seed"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _pattern(s["left"]).alias("pattern")))
    cut = rows.select("doc_id", F.xxhash64("text").alias("of"), F.transform("seeds", strip).alias("spans"), F.filter(both, lambda m: m["pattern"].isNotNull() | ~m["seed"]).alias("mentions"))
    return checkpointed(cut.select(F.monotonically_increasing_id().alias("uid"), "*"))


def bootstrap(found: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Known instances beyond the seeds: value, pattern and score, from the mentions of all rows."""
    edges = found.select(F.explode("mentions").alias("m")).select("m.pattern", "m.value", "m.seed").where("pattern is not null")
    edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # A pattern's known instances are at most its distinct ones, so only patterns with enough of these can become confident.
    rich = edges.groupBy("pattern").agg(F.count("*").alias("s")).where(F.col("s") >= support).select("pattern")
    edges = checkpointed(edges.join(rich, "pattern").withColumn("belief", F.col("seed").cast("double")))
    while True:
        patterns = edges.groupBy("pattern").agg((F.sum("belief") / F.count("*")).alias("score"), F.count_if(F.col("belief") >= confident).alias("known"))
        sure = patterns.where((F.col("score") >= confident) & (F.col("known") >= support)).select("pattern", "score")
        scored = edges.drop("was", "score").withColumnRenamed("belief", "was").join(sure, "pattern", "left")
        doubt = F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999999))))
        instances = scored.groupBy("value").agg(F.max("seed").alias("is_seed"), (1 - F.exp(doubt)).alias("belief_"))
        edges = checkpointed(scored.join(instances, "value").select("pattern", "value", "seed", "n", "score", "was", F.when(F.col("is_seed"), 1.0).otherwise(F.col("belief_")).alias("belief")))
        if edges.where(F.abs(F.col("belief") - F.col("was")) > STILL).isEmpty():
            break
    return edges.where((~F.col("seed")) & F.col("score").isNotNull() & (F.col("belief") >= confident)).select("pattern", "value", F.col("belief").alias("score"))


def _discovered(found: DataFrame) -> DataFrame:
    """uid, of, and the spans and values that bootstrapping adds."""
    known = bootstrap(found).select("value").distinct()
    each = found.select("uid", "of", F.explode("mentions").alias("m")).where("not m.seed").select("uid", "of", "m.*")
    return each.join(broadcast_if_small(known), "value").select("uid", "of", "start", "end", "value")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row: seeds and what their contexts discover."""
    found = mentions(docs)
    span = F.struct(F.lit("context").alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    more = _discovered(found).groupBy("uid").agg(F.collect_set(span).alias("more"))
    return found.select("uid", "doc_id", "spans").join(more, "uid", "left").select("doc_id", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def _covered(text: Column, spans: Column) -> Column:
    """The text with each span, in order of start, as its kind in brackets. Each part of the spans is put into its own stretch of the text."""

    def cover(cut: Column, origin: Column) -> Callable[[Column, Column], Column]:
        def add(acc: Column, s: Column) -> Column:
            # A span that begins in an earlier one only lengthens it.
            between = F.substring(cut, (acc["at"] - origin + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

        return add

    def put(x: Column) -> Column:
        cut = F.substring(text, (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int"))
        return _let(cut, lambda c: F.aggregate(x["part"], F.struct(x["begin"].alias("at"), F.lit("").alias("out")), cover(c, x["begin"]))["out"])

    def join(parts: Column) -> Column:
        zero = F.lit(0).cast("long")
        reach = F.transform(parts, lambda p: F.aggregate(p, zero, lambda n, s: F.greatest(n, s["end"])))
        ends = _before(reach, zero, lambda a, b: F.greatest(a, b))

        def whole(e: Column) -> Column:
            stretches = F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.get(e, i).alias("begin"), F.get(e, i + 1).alias("end")))
            tail = F.substring(text, (F.element_at(e, -1) + 1).cast("int"), F.char_length(text))
            return F.concat(F.array_join(F.transform(stretches, put), ""), tail)

        return _let(ends, whole)

    return _let(_parts(spans), join)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of seeds and discovered identifiers replaced by their kind in brackets, and n_chars, where there is one, to match; null text stays null.

    Spans go back to the rows by their text, so rows without an id or with a repeated one
    are treated like others, and the same characters elsewhere in a text stay. All columns stay, whatever their names.
    """
    columns = docs.columns
    span = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.lit("context").alias("kind"))
    rest = broadcast_if_small(_discovered(mentions(docs)).groupBy("of").agg(F.collect_set(span).alias("found")))
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("of"))
    seeds = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    cut = rows.join(rest, "of", "left").withColumn("spans", F.array_sort(F.when(F.col("found").isNull(), seeds).otherwise(F.concat(seeds, "found"))))
    hidden = cut.withColumn("hidden", F.when(F.size("spans") > 0, _covered(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    row = F.col("row").withField("text", F.col("hidden"))
    if "n_chars" in columns:
        row = row.withField("n_chars", F.char_length("hidden").cast(docs.schema["n_chars"].dataType))
    return hidden.select(row.alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])
