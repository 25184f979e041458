"""Personal data: identifiers of known form, and unseen ones that the contexts of known ones give away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelmark.llm.batches import prepare
from duelmark.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The forms of the identifiers. They find what plain greedy patterns find: a match starts where its run of characters does, or
# where the last match ended, and what nothing follows is matched possessively, so that no text makes them backtrack.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD_WITH_DIGIT = r"(?<!\S)(?=\S*[0-9@])\S++"
REACH = 60                      # characters of context on either side
LEAST_DIGITS = 6                # of a candidate without an at sign
ROUNDS = 3
CONFIDENT = 0.8                 # score of the patterns that discover identifiers
SUPPORT = 5                     # distinct seeds that such a pattern needs
STEP = 128                      # matches summed at once for their places

SPAN = "array<struct<start: long, rank: int, stop: long, value: string>>"
PLACE = "array<struct<start: long, rank: int, stop: long, value: string, before: string, after: string>>"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def found(text: Column, form: str) -> Column:
    """Matches from left to right as structs (start, stop, value, before, after), places in code points, end exclusive.

    ``before`` and ``after`` are the text next to a match, up to ``REACH`` characters or the match beside it: they come from the
    piece there, so that a text's length does not count for each of its matches. The pieces between the matches and the matches themselves alternate, so places are sums of their lengths; sums over
    ``STEP`` lengths are made first, so a text with n matches costs n * (STEP + n / STEP).
    """
    def places(v: Column) -> Column:
        pieces, matches = v["pieces"], v["matches"]
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))

        def summed(numbers: Column) -> Column:
            return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)

        def placed(s: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STEP).cast("int")),
                                 lambda b: summed(F.slice(s, b * STEP + 1, F.lit(STEP))))

            def each(bl: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    block = F.floor(i / STEP).cast("int")
                    before = summed(F.slice(bl, F.lit(1), block)) + summed(F.slice(s, block * STEP + 1, i % STEP))
                    start = before + F.length(pieces[i])
                    return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("value"),
                                    F.right(pieces[i], F.lit(REACH)).alias("before"), F.left(pieces[i + 1], F.lit(REACH)).alias("after"))

                return F.transform(matches, one)

            return let(blocks, each)

        return F.when(F.size(matches) > 0, let(sizes, placed)).otherwise(
            F.array().cast("array<struct<start: long, stop: long, value: string, before: string, after: string>>"))

    return let(F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("matches"), F.split(text, form, -1).alias("pieces")), places)


def valid(kind: str, value: Column) -> Column:
    """What a match of the form must satisfy besides."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # leading zeros do not count
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds by start, then kind: (start, rank of the kind, stop, value, before, after)."""
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = text.rlike("[0-9]")

    def of(rank: int, kind: str) -> Column:
        kept = F.filter(found(text, FORMS[kind]), lambda s: valid(kind, s["value"]))
        spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"),
                                                     s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
        return F.when(gate.get(kind, digit), spans).otherwise(F.array().cast(PLACE))

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def candidates(text: Column) -> Column:
    """Words that could be identifiers, without the punctuation around them; their rank is -1."""
    def bare(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[\"'(\[{<]*+", 0))
        core = F.regexp_replace(F.substring(s["value"], lead + 1, F.length(s["value"])), r"[\"')\]}>.,;:!?]++$", "")
        start = s["start"] + lead
        return let(core, lambda c: F.struct(start.alias("start"), F.lit(-1).alias("rank"), (start + F.length(c)).alias("stop"), c.alias("value"),
                                           s["before"].alias("before"), s["after"].alias("after")))

    words = F.transform(found(text, WORD_WITH_DIGIT), bare)
    likely = F.filter(words, lambda s: (F.contains(s["value"], F.lit("@")) & (F.length(s["value"]) > 2))
                      | (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= LEAST_DIGITS))
    return F.when(text.rlike("[0-9@]"), likely).otherwise(F.array().cast(PLACE))


def patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of the text around a place: the word before, the two words before, the words on both sides."""
    def words(part: Column) -> Column:
        return F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}=]+"), lambda w: w != "")

    def made(v: Column) -> Column:
        left, right = F.try_element_at(v["b"], F.lit(-1)), F.try_element_at(v["a"], F.lit(1))
        pair = F.try_element_at(v["b"], F.lit(-2))
        return F.filter(F.array(F.concat(left, F.lit(" _")), F.concat(pair, F.lit(" "), left, F.lit(" _")),
                                F.concat(left, F.lit(" _ "), right)), lambda p: p.isNotNull())

    return let(F.struct(words(before).alias("b"), words(after).alias("a")), made)


def strong_patterns(places: DataFrame) -> DataFrame:
    """(pattern, rank) of high confidence from ``places`` (rank, value, pattern), rank -1 for candidates.

    Patterns and values form a bipartite graph. A value of known form scores 1 for its kind. In each round a pattern's score
    for a kind is the sum of its values' scores over their number plus one, and a candidate's is the chance
    that one of its patterns is right. Sums are made before rows move, so a very common pattern or value is no hot key in
    them; the graph is written once, and each round's scores too.
    """
    edges = materialize(places.groupBy("pattern", "value").agg(F.max("rank").alias("rank")), "pii-edges")
    degree = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-degree")
    seeds = edges.filter("rank >= 0").select("pattern", "value", "rank").withColumn("score", F.lit(1.0))
    support = seeds.groupBy("pattern", "rank").agg(F.sum("score").alias("sum"), F.count("*").alias("seeds"))
    support = materialize(support, "pii-support")
    unknown = edges.filter("rank < 0").select("pattern", "value")
    sums = support.select("pattern", "rank", "sum")
    for _ in range(ROUNDS):
        scores = sums.groupBy("pattern", "rank").agg(F.sum("sum").alias("sum")).join(degree, "pattern")
        scores = materialize(scores.select("pattern", "rank", (F.col("sum") / (F.col("n") + 1)).alias("score")), "pii-scores")
        belief = unknown.join(scores, "pattern").groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        belief = materialize(belief, "pii-belief")
        more = unknown.join(belief, "value").groupBy("pattern", "rank").agg(F.sum("score").alias("sum"))
        sums = support.select("pattern", "rank", "sum").unionByName(more)
    strong = scores.filter(F.col("score") >= CONFIDENT).join(support.select("pattern", "rank", "seeds"), ["pattern", "rank"])
    return materialize(strong.filter(F.col("seeds") >= SUPPORT).select("pattern", "rank", "score"), "pii-strong")


def find_private_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every row.

    Spans of known form come from the whole text. Their contexts become patterns; Spark scores the graph of patterns and
    identifiers in rounds, and candidates in the context of confident patterns are added with the kind those
    patterns stand for. All of it is SQL expressions and joins. Only identifiers and their contexts, not texts, are
    written and moved.

    A null text counts as empty; ids may be null or repeat, rows are told apart by a number of their own.

    Returns one row per input row: the id, base (array of start, rank of the kind, stop, value), added (the same).
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("words", candidates(F.col("text")))
    places = F.transform(F.concat("base", "words"), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), F.lower(s["value"]).alias("value"),
        patterns(s["before"], s["after"]).alias("patterns")))
    base = F.transform("base", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "stop", "value"))))
    marked = rows.select("doc", base.alias("base"), F.when(F.size("base") + F.size("words") > 0, places).alias("places"))
    marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "pii")

    each = marked.select("row", F.inline("places")).select("row", "start", "rank", "stop", "value", F.explode("patterns").alias("pattern"))
    strong = strong_patterns(each.select("rank", "value", "pattern"))
    hits = each.filter("rank < 0").drop("rank").join(strong, "pattern")
    best = hits.groupBy("row", "start", "stop", "rank").agg(F.max("score").alias("score"), F.first("value").alias("value"))
    # a word that lies in a span of known form is no discovery
    best = best.join(marked.select("row", "base"), "row").filter(
        ~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"])))
    best = best.groupBy("row", "start", "stop").agg(F.min(F.struct((-F.col("score")).alias("score"), "rank", "value")).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", F.col("b.rank").alias("rank"), "stop", F.col("b.value").alias("value"))).alias("added"))
    out = marked.select("row", "doc", "base").join(materialize(added, "pii-added"), "row", "left")
    return out.select(F.col("doc").alias(doc_id), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def count_of(spans: str, rank: int) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
