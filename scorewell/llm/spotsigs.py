"""SpotSigs document fingerprints: chains of content words that follow common words.

Every common word of four languages is an anchor; with the content words after it, other common words passed over,
it forms a signature. Boilerplate has few anchors, running text many, so the set of signatures is of the text proper.
The start of a text is an anchor too, so that no text with words is without a signature. A fingerprint is
the sorted set, twelve hexadecimal digits each. Likeness is the Jaccard index; pairs whose set sizes
alone put it below the threshold are never compared.
"""

from __future__ import annotations

import math
import re
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.batches import slices
from scorewell.operators.prefix import quantile_cuts, with_ranges
from scorewell.session import materialize

WORD = re.compile(r"\w+")
CHAIN = 2
DIGITS = 12
COMMON = frozenset(
    "the of and to in a is that it for on was as with be by are this at from an or not have has had but they his her which "
    "der die das und ist von zu den mit im für auf ein eine dem nicht als auch es sich des "
    "le la les des et est une un que qui dans pour pas sur par avec du au il ne "
    "el los las que y en un una por con para del se su al lo como más".split()
)


def signatures(text: str | None) -> frozenset[str]:
    """The set of signatures of a text; empty for one without words. Common words alone are one signature together."""
    words = WORD.findall((text or "").lower())
    content, spots = [], [(0, "")]
    for w in words:
        if w in COMMON:
            spots.append((len(content), w))
        else:
            content.append(w)
    hexed = xxhash.xxh64_hexdigest
    if words and not content:
        return frozenset({hexed(" ".join(words))[:DIGITS]})
    chains = ((w, content[at : at + CHAIN]) for at, w in spots)
    # Only the start may have a shorter chain: it is all that a very short text has.
    return frozenset(hexed(f"{w} {' '.join(c)}")[:DIGITS] for w, c in chains if len(c) == CHAIN or (c and not w))


def to_fingerprint(found: frozenset[str]) -> str:
    return "".join(sorted(found))


def from_fingerprint(text: str) -> frozenset[str]:
    return frozenset(text[i : i + DIGITS] for i in range(0, len(text), DIGITS))


def likeness(a: frozenset[str], b: frozenset[str], least: float = 0.0) -> float:
    """Jaccard index of two sets (1 for two empty ones); 0 without comparing when sizes put it below ``least``."""
    low, high = sorted((len(a), len(b)))
    if not high:
        return 1.0
    if low < least * high:
        return 0.0
    both = len(a & b)
    return both / (low + high - both)


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spot_fingerprint`` (a null text counts as empty; a column of that name is replaced)."""
    own = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x != "spot_fingerprint"])
    at = own.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            found = [to_fingerprint(signatures(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "spot_fingerprint"])

    return own.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + ", spot_fingerprint string")


def similar_pairs(fingerprints: DataFrame, least: float = 0.8) -> DataFrame:
    """(left, right, likeness) for distinct fingerprints (column ``fp``) whose likeness is at least ``least``.

    Sets are dealt out by classes of length, each ``1 / least`` times as long as the last, so a partner is in the
    same class or the next. Within a class sets meet on one of their rarest signatures: two sets of that likeness
    share one among the first ``n - ceil(least * n) + 1`` of each. Empty fingerprints have no partner.
    """
    size = F.length("fp") / DIGITS
    sets = fingerprints.where("length(fp) > 0").select("fp", size.cast("int").alias("n")).distinct()
    cut = f"transform(sequence(1, n), i -> substr(fp, (i - 1) * {DIGITS} + 1, {DIGITS}))"
    single = sets.select("fp", "n", F.explode(F.expr(cut)).alias("sig"))
    rare = single.groupBy("sig").agg(F.count("*").alias("df"))
    ordered = single.join(rare, "sig").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    step = math.log(1 / least)
    band = F.floor(F.log("n") / step + 1e-9)
    prefix = F.expr(f"slice(sigs, 1, n - cast(ceil({least} * n - 1e-9) AS int) + 1)")
    keyed = ordered.select("fp", "n", band.alias("band"), F.explode(F.transform(prefix, lambda s: s["sig"])).alias("sig"))
    keyed = materialize(keyed, "spots")
    right = keyed.select(F.col("fp").alias("right"), F.col("n").alias("m"), "sig", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    met = keyed.withColumnRenamed("fp", "left").join(right, ["sig", "band"])
    sizes = F.least("n", "m") >= least * F.greatest("n", "m")
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("left") < F.col("right")))
    pairs = met.where(sizes & once & (F.col("left") != F.col("right"))).select("left", "right").distinct()

    def run(batches):
        for batch in slices(batches):
            sides = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [likeness(from_fingerprint(a), from_fingerprint(b), least) for a, b in sides]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["left", "right", "likeness"])

    return pairs.mapInArrow(run, "left string, right string, likeness double").where(F.col("likeness") >= least)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, range, extra): rows dealt by range of id, in order, with the first row of the next range at each end.

    A null id comes first; rows of one id follow in the order of their texts; the last range ends with the first row of all.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_ranges(rows, quantile_cuts(rows.select("place"), ["place"], 2 * n)).withColumnRenamed("place__range", "range")
    starts = ranged.groupBy("range").agg(F.min("place").alias("place")).orderBy("range").collect()  # one row per range
    before = [(int(r["range"]), r["place"], int(starts[i - 1]["range"])) for i, r in enumerate(starts)]
    if not before:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(False).alias("extra"))
    firsts = F.broadcast(docs.sparkSession.createDataFrame(before, "range int, place double, to int"))
    copies = ranged.join(firsts, ["range", "place"], "left")
    dealt = copies.select(
        "doc_id", "text", F.explode(F.expr(
            "filter(array(named_struct('range', range, 'extra', false), named_struct('range', to, 'extra', true)), x -> x.range IS NOT NULL)"
        )).alias("d")
    ).select("doc_id", "text", "d.range", "d.extra")
    return dealt.repartition(2 * n, "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of every document, of its edited text and how near they are to each other and to the next document.

    Edited: the last ``n_chars // share`` code points replaced by as many (or all) of the next document's first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # range, extra, id, text, signatures
        for batch in slices(batches):
            out = []
            for doc, text, group, extra in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                row = (group, extra, doc, text, signatures(text))
                if held and held[0] == group and not held[1]:
                    _, _, i, own, sigs = held
                    k = len(own) // share
                    edited = own[: len(own) - k] + text[:k]
                    new = signatures(edited)
                    digest = sha256(edited.encode()).hexdigest()
                    prints = (to_fingerprint(sigs), to_fingerprint(new))
                    out.append((i, len(own), digest, *prints, likeness(sigs, new), likeness(sigs, row[4])))
                held = row
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
