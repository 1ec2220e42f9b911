"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most `max_epochs` times its own size; what a capped source
cannot take is shared again by weight. A source whose target is e times its size and a bit takes e complete epochs
and then a weighted sample without replacement: each document draws -ln(u) / quality weight, and the documents with
the smallest keys go in until the word budget is met (the boundary document goes in if that brings the sum nearer).

The order of a source is never sorted in one task. Keys are mapped to 48-bit integers and cut radix-wise: sums of
256 ranges per source find the range of the budget, then its 256 subranges, and only the last range is sorted.

Edge cases: a null source is a source of its own, last in order; null, empty and wordless texts have size zero and
take zero; sources of size zero have target zero; documents without a quality label weigh 1; equal rows draw equal
keys and are told apart by nothing, so one of them may be taken; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, keyed_uniform, read

#: Most sources a mixture may have; their totals are handled on the driver.
MAX_SOURCES = 10_000
_RADIX = 256


def word_count(text) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    spaces = F.length(plain) - F.length(F.translate(plain, " ", ""))
    single = F.size(F.split(plain, " +"))
    return F.when(plain == "", 0).when(spaces == 0, 1).otherwise(single).cast("long")


def water_fill(sizes: list[int], weights: list[float], max_epochs: float) -> list[float]:
    """Targets that sum to the total size, in proportion to the weights, none above max_epochs times its size."""
    target = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    budget = float(sum(sizes))
    while free:
        unit = budget / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > max_epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = float(max_epochs * sizes[i])
            budget -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def source_plan(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target, epochs, rest) with one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    totals.sort(key=lambda r: (r.source is None, (r.source or "")))
    sizes = [int(r.n) for r in totals]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_epochs)
    rows = [(r.source, n, t, min(int(t // n), max_epochs) if n else 0, t - n * min(int(t // n), max_epochs) if n else 0.0) for r, n, t in zip(totals, sizes, target)]
    return sized.sparkSession.createDataFrame(rows, "source string, source_size long, target double, epochs int, rest double")


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, seed: str = "mix", row: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs.

    quality: (doc_id, weight), at most one row per document; the sampling rate of a document is its weight.
    row: a long that tells rows apart, handed through as `row`; it breaks ties and stands for a null doc_id in the draw.
    """
    told = [] if row is None else ["row"]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *[row.alias(c) for c in told])
    uniform = keyed_uniform(seed, F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", *told)]))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    draw = -F.log(uniform) / F.coalesce("weight", F.lit(1.0))
    sized = checkpointed(sized.withColumn("key", F.floor((1 - F.exp(-draw)) * float(2**48)).cast("long")).drop("weight"))
    plan = F.broadcast(source_plan(sized, weights, max_epochs))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    planned = sized.alias("d").join(plan.alias("p"), same("d", "p")).select("d.*", "p.source_size", "p.target", "p.epochs", "p.rest")
    # Each level narrows the boundary of a source to one of 256 ranges of its keys.
    low, rest = F.lit(0).cast("long"), F.col("rest")
    bound = plan.select("source", low.alias("low"), rest.alias("left"))
    for level, shift in enumerate((40, 32, 24)):
        span = 1 << shift
        inside = planned.alias("d").join(F.broadcast(bound).alias("b"), same("d", "b")).where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + span * _RADIX))
        sums = inside.groupBy("d.source", "low", "left", F.shiftright(F.col("key") - F.col("low"), shift).alias("range")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        passed = sums.withColumn("upto", F.sum("words").over(upto)).groupBy("source", "low", "left").agg(
            F.sum(F.when(F.col("upto") < F.col("left"), F.col("words")).otherwise(0)).alias("before"),
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), F.col("range"))), F.lit(_RADIX - 1)).alias("range"),
        )
        bound = checkpointed(passed.select("source", (F.col("low") + F.col("range") * span).alias("low"), (F.col("left") - F.col("before")).alias("left")).limit(MAX_SOURCES + 1))
    fine = planned.alias("d").join(F.broadcast(bound).alias("b"), same("d", "b"), "left").select("d.*", "b.low", "b.left")
    edge = fine.where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + span))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size", *told).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(upto)).withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("left")) & (F.col("rest") > 0))
    clear = fine.where(~F.coalesce((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + span), F.lit(False))).withColumn("more", F.coalesce(F.col("key") < F.col("low"), F.lit(False)) & (F.col("rest") > 0))
    both = clear.unionByName(edge.drop("upto"))
    copies = F.col("epochs") + F.col("more").cast("int")
    return both.select("doc_id", *told, "source", "size", "source_size", F.round("target", 6).alias("target"), copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents labelled good, 0.5 for those labelled bad (the lowest label counts)."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(F.col("q") > 0, 2.0).otherwise(0.5).alias("weight"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with source weights 1, 2, 3, repeating."""
    mixed = mix_sources(read(spark, sf_dir, "documents"), label_weights(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with w as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::bigint as bits, l.q
  from documents d left join (select doc_id, min(quality) q from labels where quality is not null group by 1) l using (doc_id)
), k as (
  select *, floor((1 - exp(ln((bits + 0.5) / 4503599627370496.0) / (case when q > 0 then 2.0 when q is not null then 0.5 else 1.0 end))) * 281474976710656.0)::bigint as key from w
), s as (
  select source, sum(size)::bigint as n, ((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::double as weight from w group by source
), r as (
  select *, 3.0 * n / weight as ratio,
         row_number() over (order by 3.0 * n / weight, source) as place,
         coalesce(sum(3.0 * n) over (order by 3.0 * n / weight, source rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(weight) over (order by 3.0 * n / weight, source rows between current row and unbounded following) as open, sum(n) over () as total from s where n > 0
), f as (select arg_min((total - capped) / open, place) as unit from r where (total - capped) / open <= ratio),
t as (
  select s.source, s.n, case when s.n = 0 then 0.0 else least(s.weight * f.unit, 3.0 * s.n) end as target from s, f
), p as (
  select *, case when n = 0 then 0 else least(floor(target / n), 3) end::bigint as epochs from t
), q as (
  select k.doc_id, k.size, p.n, p.target, p.epochs, p.target - p.n * p.epochs as rest,
         sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) as upto
  from k join p on k.source is not distinct from p.source
)
select doc_id, size, n as source_size, round(target, 6) as target,
       (size * (epochs + (case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end)))::bigint as taken from q
"""


def queries() -> dict:
    return {"op4_mixing": op4_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": ORACLE}
