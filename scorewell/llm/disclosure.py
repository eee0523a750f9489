"""Personal data: pattern spans, and terms that reveal the entities found, by corpus co-occurrence.

Protected are the values that the patterns find. A term reveals an entity as far as knowing the term makes the
entity likely: pointwise mutual information over whole texts, as a share of the entity's own information (1: whoever reads the
term knows the entity). Terms above one threshold are generalised, above a higher one removed, in every text in which they stand.

Texts are counted, not documents, so copies say nothing new. The chance of an entity given a term is taken from the other texts, as whoever
reads one text knows only those, and as the lower end of a confidence interval, for where few texts show a pair it may be chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.functions.exprs import lit_text
from scorewell.llm.spans import NONE, spans_sql
from scorewell.operators.duplicates import split_by_filter
from scorewell.session import materialize

KINDS = ["email", "ip", "card", "phone", "term"]
#: Standard deviations between the observed chance of an entity and the one that counts (95 %, one-sided).
DOUBT = 1.645
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"[\p{L}][\p{L}\p{N}'-]{2,}"

# Possessive repeats match what the greedy ones do, for what follows never fits into them, but need no stack.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_TWICE = "int(substr(d, -i, 1)) * 2"
LUHN = (
    f"exists(array({DIGITS}), d -> length(d) BETWEEN 12 AND 19 AND aggregate(sequence(1, length(d)), 0, (t, i) -> t + "
    f"CASE WHEN i % 2 = 1 THEN int(substr(d, -i, 1)) WHEN {_TWICE} > 9 THEN {_TWICE} - 9 ELSE {_TWICE} END) % 10 = 0)"
)
PARTS = "forall(split({v}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(right(p, 3)) <= 255)"
COUNTED = f"length({DIGITS}) BETWEEN 9 AND 15"


def base_spans(text: str) -> str:
    """Sorted spans of all pattern kinds in the column ``text`` (never null)."""
    found = [
        spans_sql(text, "email", 0, EMAIL, f"instr({text}, '@') > 0"),
        spans_sql(text, "ip", 1, IP, f"{text} RLIKE '[0-9][.][0-9]'", PARTS),
        spans_sql(text, "card", 2, CARD, f"{text} RLIKE '[0-9](?:[ -]?[0-9]){{11}}'", LUHN),
        spans_sql(text, "phone", 3, PHONE, f"instr({text}, '+') > 0", COUNTED),
    ]
    return f"array_sort(concat({', '.join(found)}))"


def masked(text: str, spans: str) -> str:
    """SQL for the text with blanks in place of its spans, at the same length."""
    step = (
        f"if(s.end <= acc.at, acc, named_struct('at', s.end, 'out', concat(acc.out, substr({text}, acc.at + 1, greatest(s.start - acc.at, 0)), "
        "repeat(' ', s.end - greatest(s.start, acc.at)))))"
    )
    whole = f"aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, s) -> {step}, acc -> concat(acc.out, substr({text}, acc.at + 1)))"
    return f"if(size({spans}) = 0, {text}, {whole})"


def terms_sql(text: str) -> str:
    """The different lower-cased terms of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, {lit_text(TERM)}, 0), x -> lower(x)))"


def term_spans(text: str, verdicts: str) -> str:
    """Spans of the terms of ``text`` that the map ``verdicts`` holds; their value is the verdict."""
    p = lit_text(TERM)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"
    start, value = "acc.at + length(x.`0`)", f"{verdicts}[lower(x.`1`)]"
    one = f"named_struct('start', {start}, 'rank', 4, 'end', {start} + length(x.`1`), 'kind', 'term', 'value', {value})"
    return (
        f"aggregate({zipped}, named_struct('at', 0, 'all', {NONE}), (acc, x) -> if(x.`1` IS NULL, acc, named_struct("
        f"'at', {start} + length(x.`1`), 'all', if({value} IS NULL, acc.all, concat(acc.all, array({one}))))), acc -> acc.all)"
    )


def text_frequencies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, df): in how many different texts each term stands. ``rows``: doc_id, text_hash, rest; ``copies``: text_hash, k, least.

    Terms are counted over all rows, folded per task; what the copies of a text add is taken off again, from one row of it.
    """
    counted = rows.select(F.explode(F.expr(terms_sql("rest"))).alias("term"), F.lit(1).alias("w"))
    more = materialize(copies.where("k > 1"), "copies")
    n = more.count()
    if n:
        kept = F.xxhash64("doc_id", "text_hash")
        _, likely = split_by_filter(rows, kept, more.select(F.xxhash64("least", "text_hash").alias("number")), n)
        # Rows that the filter lets through by chance fall together with their text's row, or have no copies.
        once = likely.groupBy("text_hash").agg(F.min("rest").alias("rest")).join(more, "text_hash")
        counted = counted.union(once.select(F.explode(F.expr(terms_sql("rest"))), 1 - F.col("k")))
    return counted.groupBy("term").agg(F.sum("w").alias("df"))


def _alike(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(``key``, class): keys with the same texts (``text_hash``) and the same columns ``more`` have one class, by 128 bits of hash."""
    sums = [F.sum(F.xxhash64("text_hash", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2)]
    return rows.groupBy(key, *more).agg(F.struct(*sums, F.count("*"), *more).alias("class")).select(key, *more, "class")


def risky_terms(known: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """(term, value): the terms that reveal an entity, and what is to be done with them.

    ``known``: text_hash, entities, terms, for each different text with entities; ``df``: term, df; ``total``: number of texts.
    Entities that stand in the same texts have the same figures and are one, and so are terms. Before any pair is made, what cannot
    reach the threshold goes: an entity of one text, and a term in so many texts that even with all of the entity's it stays below.
    """
    entities = known.select("text_hash", F.explode("entities").alias("entity"))
    entities = materialize(entities, "entities")
    sizes = _alike(entities.join(entities.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1"), "entity"), "entity", "n")
    sizes = materialize(sizes.withColumn("most", F.expr(f"1 + (n - 1) * pow({float(total)!r}D / n, {1 - GENERALISE!r}D)")), "sizes")
    most = sizes.agg(F.max("most")).first()[0]
    held = entities.join(sizes, "entity").select("text_hash", "class", "n", "most").distinct()
    held = materialize(held.withColumnRenamed("class", "of"), "held")
    few = df.where((F.col("df") > 1) & (F.col("df") <= F.lit(most or 0.0) + 1e-6))
    spoken = known.join(held.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", F.explode("terms").alias("term"))
    spoken = materialize(spoken.join(few, "term"), "terms")
    classes = materialize(_alike(spoken, "term", "df"), "classes")
    stand = spoken.join(classes.drop("df"), "term").select("text_hash", "class", "df").distinct()
    both = stand.join(held, "text_hash").where("df <= most + 1e-6D").groupBy("class", "of", "df", "n").agg((F.count("*") - 1).alias("k"))
    # Of the m other texts with the term, k have the entity: the lower end of Wilson's interval.
    z, m = f"{DOUBT!r}D", "double(df - 1)"
    low = f"(k / {m} + {z} * {z} / (2 * {m}) - {z} * sqrt(k / {m} * (1 - k / {m}) / {m} + {z} * {z} / (4 * {m} * {m}))) / (1 + {z} * {z} / {m})"
    share = F.expr(f"1 + try_divide(ln({low}), ln({float(total)!r}D / n))")
    worst = both.where("k > 0").select("class", share.alias("share")).groupBy("class").agg(F.max("share").alias("share"))
    verdict = F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("value")
    return classes.join(worst.where(F.col("share") >= GENERALISE), "class").select("term", verdict)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans) per row: spans of the patterns, and all spans with revealing terms among them.

    The value of a term's span is ``generalise`` or ``remove``. Terms never overlap pattern spans. A null text is
    empty. Rows with equal id and text get equal results; ids may be null or repeat; an empty table gives an empty one.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", F.expr(base_spans("text")).alias("base"))
    rows = rows.select("doc_id", "text_hash", "base", F.expr(masked("text", "base")).alias("rest"))
    entities = "array_distinct(transform(base, s -> xxhash64(concat(s.kind, ':', lower(s.value)))))"
    terms = f"if(size(base) > 0, {terms_sql('rest')}, cast(array() AS array<string>))"
    found = rows.select("doc_id", "text_hash", "base", F.expr(entities).alias("entities"), F.expr(terms).alias("terms"))
    found = materialize(found, "personal")
    own = found.select("doc_id", "text_hash", "base")

    copies = materialize(found.groupBy("text_hash").agg(F.count("*").alias("k"), F.min("doc_id").alias("least")), "texts")
    known = found.where("size(base) > 0").select("text_hash", "entities", "terms")
    known = materialize(known.groupBy("text_hash").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "known")
    slim = rows.select("doc_id", "text_hash", "rest")
    # Counted for all terms and written: a join before the count would be made per occurrence.
    df = materialize(text_frequencies(slim, copies), "frequencies")
    risky = materialize(risky_terms(known, df, max(copies.count(), 1)), "risky")
    n = risky.count()
    if not n:
        return own.withColumn("spans", F.col("base"))

    every = slim.select("doc_id", "text_hash", F.explode(F.expr(terms_sql("rest"))).alias("term"))
    _, likely = split_by_filter(every, F.xxhash64("term"), risky.select(F.xxhash64("term").alias("number")), n)
    hits = likely.join(risky, "term").distinct().groupBy("doc_id", "text_hash")
    hits = materialize(hits.agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("verdicts")), "hits")
    row = F.xxhash64("doc_id", "text_hash")
    _, likely = split_by_filter(slim, row, hits.select(row.alias("number")), max(hits.count(), 1))
    likely = likely.dropDuplicates(["doc_id", "text_hash"])
    pair = hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "verdicts")
    same = lambda t: t["doc_id"].eqNullSafe(pair["__id"]) & (t["text_hash"] == pair["__hash"])
    placed = likely.join(pair, same(likely)).select("__id", "__hash", F.expr(term_spans("rest", "verdicts")).alias("added"))
    pair = materialize(placed, "placed")
    spans = F.expr(f"array_sort(concat(base, coalesce(added, {NONE})))").alias("spans")
    return own.join(pair, same(own), "left").select("doc_id", "text_hash", "base", spans)


def sanitised(text: str, spans: str) -> str:
    """SQL for the text with each span replaced by its kind in brackets, or by nothing where a term is to be removed."""
    put = "CASE WHEN s.kind <> 'term' THEN concat('[', upper(s.kind), ']') WHEN s.value = 'remove' THEN '' ELSE '[TERM]' END"
    step = (
        f"if(s.start < acc.at, acc, named_struct('at', s.end, 'out', "
        f"concat(acc.out, substr({text}, acc.at + 1, s.start - acc.at), {put})))"
    )
    return (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, s) -> {step}, "
        f"acc -> concat(acc.out, substr({text}, acc.at + 1)))"
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` sanitised: pattern spans generalised to their kind, revealing terms to [TERM] or removed."""
    found = personal_data(docs, id_col, text_col).distinct()
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(text) == found["__hash"])
    joined = docs.withColumn(text_col, text).join(found, same, "left")
    clean = F.expr(sanitised(f"`{text_col}`", f"coalesce(__spans, {NONE})"))
    return joined.withColumn(text_col, clean).select(*[F.col(f"`{x}`") for x in docs.columns])
