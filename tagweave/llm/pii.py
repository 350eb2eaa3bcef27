"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of four base patterns. The words around a seed make lexical patterns: the word before, the two
words before, the words on both sides, and, with the token's shape (its runs of letters and digits), the word before
and the label before (the first of the three words before that ends in a colon or an equals sign). Every other token
with a digit or an at sign that such a pattern surrounds is an instance. On the graph of patterns and instances,
confidence goes back and forth for ROUNDS rounds: a pattern's is the mean score of the distinct instances it surrounds,
if LEAST_SEEDS of them are seeds or were accepted in the round before; an instance's is the noisy-or of its patterns.
Instances that reach ACCEPT count as seeds in the next round, so that patterns without a base match of their own are
learned too, and in the end are added to the spans, of the kind they scored best for.

Context is read NEAR characters far; a word that goes on beyond that is no context.

Offsets are code points, ends exclusive. Base matches are leftmost and do not overlap within a kind; a match that fails
its check is dropped and not tried again. Patterns are written so that the matcher neither recurses nor scans a long
run from every place in it.

Defined cases: null and empty texts have no spans (the digest of the empty string); rows repeat and null ids are kept,
each row by itself; an empty table gives an empty result; other columns of docs, whatever their names, pass untouched
through redact() and are not read by find().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm._store import written

KINDS = ("email", "ip", "card", "phone")
#: The four base patterns. Each equals its plain form; possessive loops and the look-behinds only spare
#: work, as a match can begin inside a run only where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
NEAR = 64
ROUNDS, LEAST_SEEDS, TRUSTED, ACCEPT = 3, 3, 0.6, 0.8


def _whole(near: Column, length: Column, cut: str) -> Column:
    """near without the word that the limit of NEAR characters cuts."""
    return F.when(length > NEAR, F.regexp_replace(near, cut, "")).otherwise(near)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array of a pattern's matches: how far the last one's end lies back, the match, and the text next to it."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(hit: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), hit.alias("hit"),
            F.lower(_whole(F.substring(before, F.greatest(F.length(before) - NEAR, F.lit(0)) + 1, F.lit(NEAR)), F.length(before), r"^\S++")).alias("before"),
            F.lower(_whole(F.substring(after, 1, NEAR), F.length(after), r"(?<!\S)\S++$")).alias("after"),
        )

    return F.transform(hits, one)


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, b: a + b)
    return F.size(digits).between(13, 19) & (total % 10 == 0)


def _octet(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _octet)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


_MATCHES = "array<struct<kind:string,i:int,gap:int,hit:string,before:string,after:string>>"


def located(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number of its own, and `_found`: matches of all patterns, not yet checked."""
    text, none = F.col("text"), F.expr(f"cast(array() as {_MATCHES})")
    need = {"email": "@", "ip": ".", "card": "", "phone": "+", "token": ""}
    each = [F.when(F.contains(text, F.lit(need[k])), _matches(text, k, p)).otherwise(none) for k, p in [*PATTERNS.items(), ("token", TOKEN)]]
    return docs.withColumn("_found", F.when(text.rlike("[0-9@]"), F.concat(*each)).otherwise(none)).withColumn("_row", F.monotonically_increasing_id())


def placed(found: DataFrame) -> DataFrame:
    """found (_row, _found) -> a row for each base span and each other token: _row, kind (null for a token), s, e, value and the words around.

    Places are running sums over a text's matches of one kind.
    """
    one = found.select("_row", F.explode("_found").alias("m")).select("_row", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("e", F.sum(F.col("gap") + F.length("hit")).over(so_far).cast("int")).withColumn("s", F.col("e") - F.length("hit"))
    hit, kind = F.col("hit"), F.col("kind")
    valid = F.lit(True)
    for k in KINDS:
        valid = F.when(kind == k, _holds(k, hit)).otherwise(valid)
    value = F.when(kind == "token", F.regexp_replace(hit, r"[\p{Punct}]++$", "")).otherwise(hit)
    two = F.regexp_replace(F.regexp_extract("before", r"(?<!\S)(\S++\s++\S++)\s*+$", 1), r"\s++", " ")
    return one.where(valid).select(
        "_row", F.when(kind != "token", kind).alias("kind"), "s", (F.col("s") + F.length(value)).alias("e"), value.alias("value"),
        F.regexp_extract("before", r"(?<!\S)(\S++)\s*+$", 1).alias("left"), two.alias("two"), F.regexp_extract("after", r"^\S*+\s++(\S++)", 1).alias("right"),
        F.regexp_extract("before", r"(?<!\S)(\S*+(?<=[:=]))(?:\s++\S++){0,2}+\s*+$", 1).alias("label"),
    ).where("value <> ''")


def discovered(one: DataFrame) -> DataFrame:
    """placed spans and tokens -> (_row, kind, s, e): tokens that confident patterns surround and no base span touches."""
    order = Window.partitionBy("_row").orderBy("s", F.col("kind").asc_nulls_last())
    held = F.max(F.when(F.col("kind").isNotNull(), F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind").isNotNull(), F.col("s"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(held, F.lit(-1)) <= F.col("s")) & (F.coalesce(ahead, F.lit(2**31 - 1)) >= F.col("e"))
    one = one.withColumn("_clear", clear).where(F.col("kind").isNotNull() | F.col("_clear")).drop("_clear")
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}++", "a"), r"[0-9]++", "9")
    left, two, right, label = (F.col(c) for c in ("left", "two", "right", "label"))
    contexts = F.array(
        F.when(left != "", F.concat(F.lit("1 "), left)), F.when(two != "", F.concat(F.lit("2 "), two)),
        F.when((left != "") & (right != ""), F.concat(F.lit("3 "), left, F.lit(" _ "), right)),
        F.when(left != "", F.concat(F.lit("4 "), left, F.lit(" "), shape)), F.when(label != "", F.concat(F.lit("5 "), label, F.lit(" "), shape)),
    )
    edges = written(one.select(F.explode(F.filter(contexts, lambda x: x.isNotNull())).alias("pattern"), "value", "kind").distinct(), "edges")
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    likely = edges.groupBy("pattern").agg(F.count_distinct("value").alias("all")).where(F.col("all") >= LEAST_SEEDS)
    links = written(edges.select("pattern", "value").distinct().join(likely, "pattern"), "links")
    scores = seeds
    for _ in range(ROUNDS):
        trust = links.join(scores, "value").groupBy("pattern", "kind").agg((F.sum("score") / F.max("all")).alias("trust"), F.sum((F.col("score") >= ACCEPT).cast("int")).alias("sown"))
        trust = trust.where((F.col("trust") >= TRUSTED) & (F.col("sown") >= LEAST_SEEDS))
        new = links.join(trust.select("pattern", "kind", "trust"), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - 0.95 * F.least("trust", F.lit(1.0)))))).alias("score"))
        new = new.join(seeds.select("value").distinct(), "value", "left_anti")
        scores = written(seeds.unionByName(new), "scores")
    best = scores.where((F.col("score") < 1.0) & (F.col("score") >= ACCEPT)).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("as"))
    return one.where("kind is null").select("_row", "s", "e", "value").join(best, "value").select("_row", F.col("as").alias("kind"), "s", "e")


def find(docs: DataFrame, keep: bool = False) -> DataFrame:
    """docs (doc_id, text) -> all rows with `base` and `spans`, arrays of struct<kind, s, e> by kind as listed, then place.

    keep: with docs' own columns.
    """
    columns = docs.columns if keep else ["doc_id"]
    found = written(located(docs if keep else docs.select("doc_id", "text")).select(*columns, "_row", "_found"), "located")
    one = written(placed(found.where(F.size("_found") > 0).select("_row", "_found")), "placed")
    spans = one.where("kind is not null").select("_row", "kind", "s", "e", F.lit(True).alias("sure")).unionByName(discovered(one).withColumn("sure", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("k"), "s", "e", "kind", "sure")))
    rows = spans.groupBy("_row").agg(ordered.alias("_spans"))
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")

    def plain(items: Column) -> Column:
        return F.coalesce(F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))), none)

    out = found.drop("_found").join(rows, "_row", "left")
    return out.select(*columns, plain(F.filter("_spans", lambda x: x["sure"])).alias("base"), plain(F.col("_spans")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets; where spans overlap, by the first one's."""
    found = find(docs, keep=True)
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        free = x["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(free, piece).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = F.when(F.size("spans") > 0, text).otherwise(F.col("text"))
    out = found.withColumn("text", changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
