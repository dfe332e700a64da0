"""Personal data by bootstrapped contextual extraction: seeds teach contexts, and contexts find identifiers of other shapes.

Seeds are the spans of four exact shapes (``BASE``). Wider shapes (``WIDE``: numbers without a plus or with failing checksums,
IPv6 and defanged addresses, spelled-out mailboxes) are candidates. A mention's lexical patterns are the words around it; an
identifier in any spelling is one instance. Patterns and instances form a bipartite graph with one edge per pair:

* a pattern's confidence in a kind is the sum of its instances' scores over their number + 1; it counts from ``SUPPORT`` scored
  instances and ``PATTERN`` confidence on, so every candidate of unknown kind and every seed of another kind speaks against it;
* an instance's score is 1 - product of (1 - confidence) over its patterns, for kinds that fit its shape; seeds have 1.
  Below ``INSTANCE`` it is 0, and only the best kind stays (then the first of ``KINDS``).

Rounds repeat until no instance changes its kind, so that instances found by one pattern support others. Candidate mentions of
scored instances become spans; base spans always stay.

Everything is DataFrame operations: positions come from the lengths between matches, rounds are joins and sums. Scores are
aggregated before they move; keys (words, numbers) with over 1 / ``HEAVY`` of all edges are at most ``HEAVY``, and only their
rows of the other side are broadcast.

Defined results: null and empty texts have no span; texts may have any length (patterns never backtrack over a repeated
group); equal rows get the same spans, each its own row; added spans that overlap a base span, or an added span that starts
earlier (or with it, and is longer), are left out; ties between kinds go to the first kind; an empty table gives no row;
other columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KINDS = ["email", "ip", "card", "phone"]
#: The contract's shapes. Repeated parts can't match otherwise than greedily, so they are possessive; a match can start inside a run of
#: its first class only where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes of candidates: 7 to 19 digits; colon-separated or defanged addresses; mailboxes without a domain's dot or spelled out.
WIDE = {
    "number": r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,18}(?![A-Za-z0-9])",
    "address": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "mailbox": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++|(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?=\x20?[\[(]dot|\x20dot\x20|\.[A-Za-z0-9-]))"
               r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)*+",
}
#: What a text must hold for a shape to be looked for at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "number": "[0-9][\\x20().\\-/]{0,2}[0-9]",
         "address": "[0-9A-Fa-f]:|[0-9](?:\\[\\.|\\(\\.|\\x20dot)", "mailbox": "@|[\\[(]at[\\])]|\\x20at\\x20"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
#: Code points around a mention from which its words are taken.
LEFT, RIGHT = 96, 48
SUPPORT, PATTERN, INSTANCE, ROUNDS, HEAVY = 3, 0.5, 0.6, 6, 1000
SCORES = [f"s{k}" for k in range(len(KINDS))]


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits): every match of every shape, with the code points since the match before it and the texts around it."""
    shapes = {**BASE, **WIDE}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", *[
        F.when(F.col("text").rlike(NEEDS[k]), f).alias(f"{k}_{n}")
        for k, p in shapes.items() for n, f in (("found", F.regexp_extract_all("text", F.lit(p), F.lit(0))), ("parts", F.split("text", p, -1)))])
    rows = rows.select("row", "doc_id", *[
        F.arrays_zip(F.col(f"{k}_found").alias("found"), F.col(f"{k}_parts").alias("before"), F.slice(f"{k}_parts", 2, F.greatest(F.size(f"{k}_parts"), F.lit(1))).alias("after")).alias(k) for k in shapes])

    def shaped(k):
        full = F.filter(k, lambda z: z["found"].isNotNull())
        return F.coalesce(F.transform(full, lambda z, i: F.struct(
            F.lit(k).alias("shape"), i.alias("i"), F.char_length(z["before"]).cast("long").alias("gap"), z["found"].alias("found"),
            F.right(z["before"], F.lit(LEFT)).alias("left"), F.left(z["after"], F.lit(RIGHT)).alias("right"))),
            F.array().cast("array<struct<shape:string,i:int,gap:bigint,found:string,left:string,right:string>>"))

    return rows.select("row", "doc_id", F.concat(*[shaped(k) for k in shapes]).alias("hits"))


def valid(digits):
    """Whether a match of a base shape is a span."""
    return (F.when(F.col("shape") == "email", True).when(F.col("shape") == "ip", F.col("found").rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"))
            .when((F.col("shape") == "card") & F.char_length(digits).between(13, 19), F.expr("luhn_check(digits)"))
            .when(F.col("shape") == "phone", F.char_length(digits).between(9, 15)).otherwise(False))


def mentions(scanned: DataFrame) -> DataFrame:
    """(row, start, end, shape, base kind number or null, fits: numbers of the kinds it may be, inst, left, right) without candidates on base spans."""
    hit = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("digits", F.regexp_replace("found", "[^0-9]", ""))
    end = F.sum(F.col("gap") + F.char_length("found")).over(Window.partitionBy("row", "shape").orderBy("i"))
    spelled = F.regexp_replace(F.regexp_replace(F.lower("found"), r"\x20?[\[(]at[\])]\x20?|\x20at\x20", "@"), r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\[\.\]|\(\.\)", ".")
    size = F.char_length("digits")
    hit = hit.withColumns({
        "end": end, "start": end - F.char_length("found"), "is_base": valid(F.col("digits")),
        "inst": F.when(F.col("shape").isin("card", "phone", "number"), F.col("digits")).otherwise(spelled),
        "fits": F.when(F.col("shape") == "mailbox", F.array(F.lit(0))).when(F.col("shape") == "address", F.array(F.lit(1)))
        .when(F.col("shape") == "number", F.filter(F.array(F.when(size >= 13, 2), F.when(size <= 15, 3)), lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>")),
        "kind": F.when(F.col("shape").isin(*KINDS), F.array_position(F.array(*map(F.lit, KINDS)), F.col("shape")).cast("int") - 1)})
    hit = hit.where("is_base OR size(fits) > 0")
    by = Window.partitionBy("row").orderBy("start")
    base_end = F.max(F.when(F.col("is_base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("is_base"), F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    hit = hit.withColumn("free", free).where("is_base OR free")
    return hit.select("row", "start", "end", "shape", F.when(F.col("is_base"), F.col("kind")).alias("kind"), "fits", "inst",
                      F.when((F.col("i") == 0) & (F.col("gap") < LEFT), F.concat(F.lit("^"), "left")).otherwise(F.col("left")).alias("left"), "right")


def patterns():
    """Words left of a mention, around it and right of it, digits as 0."""
    words = lambda c: F.regexp_extract_all(F.regexp_replace(F.lower(c), "[0-9]+", "0"), F.lit(TOKEN), F.lit(0))
    left, right = words("left"), words("right")
    last = lambda n: F.array_join(F.slice(left, F.greatest(F.size(left) - (n - 1), F.lit(1)), n), " ")
    first = lambda n: F.array_join(F.slice(right, 1, n), " ")
    return F.array_distinct(F.array(*[F.concat(F.lit(f"left {n}: "), last(n)) for n in (1, 2, 3)], F.concat(F.lit("around: "), last(1), F.lit(" _ "), first(1)), F.concat(F.lit("right 2: "), first(2))))


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, inst, hot_pattern, hot_inst) and instances (inst, seeds: kinds of its base spans, fits)."""
    edges = stage(found.select("inst", F.explode(patterns()).alias("pattern")).distinct(), "pii-pairs")
    least = edges.count() // HEAVY
    for key in ("pattern", "inst"):
        hot = edges.groupBy(key).count().where(F.col("count") > least).select(key, F.lit(True).alias(f"hot_{key}"))
        hot = stage(hot, f"pii-hot-{key}")  # every key has more than 1 / HEAVY of the rows: at most HEAVY of them
        edges = edges.join(F.broadcast(hot), key, "left").withColumn(f"hot_{key}", F.coalesce(f"hot_{key}", F.lit(False)))
    nodes = found.groupBy("inst").agg(F.collect_set("kind").alias("seeds"), F.array_distinct(F.flatten(F.collect_set("fits"))).alias("fits"))
    return stage(edges, "pii-edges"), stage(nodes, "pii-nodes")


def matched(edges: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """``edges`` with the columns of ``side``, whose keys are unique: hot keys by broadcast, the others by a shuffle."""
    hot = edges.where(f"hot_{key}").select(F.col(key)).distinct()
    return edges.where(f"NOT hot_{key}").join(side, key, how).unionByName(
        edges.where(f"hot_{key}").join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key, how))


def scored(edges: DataFrame, nodes: DataFrame, support: int = SUPPORT, pattern: float = PATTERN, instance: float = INSTANCE, rounds: int = ROUNDS) -> DataFrame:
    """(inst, s0 ..): scores of seeds and of the instances that patterns find; instances without a score are absent."""
    seeds = nodes.where("size(seeds) > 0").select("inst", *[F.array_contains("seeds", k).cast("double").alias(s) for k, s in enumerate(SCORES)])
    scores, seen = seeds, None
    for _ in range(rounds):
        held = matched(edges, scores, "inst", "left").fillna(0.0, SCORES).groupBy("pattern").agg(
            F.count("*").alias("n"), *[F.sum(s).alias(s) for s in SCORES], *[F.count(F.when(F.col(s) > 0, 1)).alias(f"of_{s}") for s in SCORES])
        held = held.select("pattern", *[F.round(F.col(s) / (F.col("n") + 1), 9).alias(s) if s == "n" else F.when(
            (F.col(f"of_{s}") >= support) & (F.round(F.col(s) / (F.col("n") + 1), 9) >= pattern), F.round(F.col(s) / (F.col("n") + 1), 9)).otherwise(0.0).alias(s) for s in SCORES])
        held = stage(held.where(" OR ".join(f"{s} > 0" for s in SCORES)), "pii-patterns")
        sums = matched(edges, held, "pattern", "inner").groupBy("inst").agg(*[F.sum(F.log(1 - F.col(s))).alias(s) for s in SCORES])
        raw = sums.join(nodes.where("size(seeds) = 0"), "inst").select("inst", *[
            F.when(F.array_contains("fits", k) & (F.round(1 - F.exp(s), 9) >= instance), F.round(1 - F.exp(s), 9)).otherwise(0.0).alias(s) for k, s in enumerate(SCORES)])
        best = F.greatest(*SCORES)
        alone = raw.where(best > 0).withColumn("k", F.array_position(F.array(*SCORES), best) - 1)
        alone = alone.select("inst", *[F.when(F.col("k") == k, F.col(s)).otherwise(0.0).alias(s) for k, s in enumerate(SCORES)])
        scores = stage(seeds.unionByName(alone), "pii-scores")
        state = scores.agg(F.count("*"), F.sum(F.xxhash64("inst", *[F.col(s) > 0 for s in SCORES]).cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return scores


def spans(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (row, doc_id) and the spans (row, kind, start, end, is_base): what the shapes match and what contexts add."""
    scanned = stage(scan(docs), "pii-scan")
    found = stage(mentions(scanned), "pii-mentions")
    edges, nodes = graph(found)
    scores = scored(edges, nodes, **how)
    best = scores.select("inst", F.filter(F.array(*[F.when(F.col(s) > 0, F.struct(F.col(s).alias("score"), F.lit(-k).alias("first"))) for k, s in enumerate(SCORES)]), lambda x: x.isNotNull()).alias("of"))
    # a candidate takes the best kind among those that fit its own shape
    wide = found.where("kind IS NULL").withColumn("hot", F.lit(False))
    named = wide.join(best, "inst").withColumn("kind", F.array_max(F.filter("of", lambda x: F.array_contains(F.col("fits"), -x["first"])))["first"] * -1).where("kind IS NOT NULL")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", F.desc("end"), "shape").rowsBetween(Window.unboundedPreceding, -1))
    added = named.withColumn("before", before).where("before IS NULL OR before <= start")
    return scanned.select("row", "doc_id"), found.where("kind IS NOT NULL").select("row", "kind", "start", "end", F.lit(True).alias("is_base")).unionByName(
        added.select("row", "kind", "start", "end", F.lit(False).alias("is_base")))


def redacted(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text): every span replaced by its kind in brackets; overlapping spans become one mark, of the first of them."""
    keyed = stage(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id()), "pii-texts")
    ids, found = spans(keyed.select(F.col("_row").alias("doc_id"), "text"), **how)
    ids = ids.withColumnRenamed("doc_id", "_row")
    by = Window.partitionBy("_row").orderBy("start", F.desc("end"), "kind")
    found = found.join(ids, "row").withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("mark", F.sum(F.when(F.col("reach").isNull() | (F.col("reach") <= F.col("start")), 1).otherwise(0)).over(by))
    marks = found.groupBy("_row", "mark").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    until = F.lead("start").over(Window.partitionBy("_row").orderBy("start"))
    marks = marks.withColumn("until", until).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "until", "kind"))).alias("marks"))
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x}]") for x in KINDS]), k + 1)
    piece = lambda m: F.concat(name(m["kind"]), F.substring(F.col("text"), m["end"].cast("int") + 1, (F.coalesce(m["until"], F.lit(2**31 - 1)) - m["end"]).cast("int")))
    return keyed.join(marks, "_row", "left").select("doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(
        F.concat(F.substring(F.col("text"), F.lit(1), F.element_at("marks", 1)["start"].cast("int")), F.array_join(F.transform("marks", piece), ""))).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    rows, found = spans(docs)
    shown = lambda only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("kind", "start", "end")))), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    by = found.groupBy("row").agg(*[F.count(F.when(F.col("is_base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                                  shown(F.col("is_base")).alias("base"), shown(F.lit(True)).alias("spans"))
    return rows.join(by, "row", "left").select("doc_id", *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS],
                                               F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
