"""Secrets in texts, and who else has them: all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, quoted, written


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, pattern, group that is the value, least characters of the value; in the order that ties are listed in.
KINDS = [
    ("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("key", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
]
BASE = ("assign", "access", "hex")
#: A value is a widely copied example if this many owners hold it, or two or more in this many repositories together.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 5, 20
MASK = "[SECRET]"


def _found(text: Column, order: int) -> Column:
    """The kind's matches in a text: order, index, characters before it since the last one, length, value."""
    _, pattern, group, _ = KINDS[order]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    all_ = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else all_
    zipped = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(all_, F.char_length).alias("size"), values.alias("value")),
        lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")),
    )
    empty = F.array().cast("array<struct<order:int,i:int,gap:int,size:int,value:string>>")
    # what follows the last match is no match
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["size"].isNotNull())).otherwise(empty)


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """row, doc_id, same (a hash of the text), kind order, start, stop, hash of the value and live, for each span.

    Offsets are code points, found from the lengths of what a kind's pattern matches and of what is between.
    A value's owners are counted over all documents: each (value, owner, repository) once, then owners and
    repositories of each value. One that EXAMPLE_OWNERS owners or more hold is a copied example, and so is one that
    two owners or more have in EXAMPLE_REPOSITORIES repositories; others, which one owner alone has however often or
    few have in few places, are live-looking. Spans of the kind `key` (20 characters of at least a digit, a capital and a small letter)
    are added where they are live and clear of all others. Texts are scanned once: the spans are written before
    they are counted and judged.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("same"), text.alias("text"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    some = rows.where(F.col("text").rlike("|".join(f"(?:{p})" for _, p, _, _ in KINDS)))
    found = some.select("row", "doc_id", "same", "owner", "repository", F.explode(F.concat(*[_found(F.col("text"), k) for k in range(len(KINDS))])).alias("m"))
    found = found.select("row", "doc_id", "same", "owner", "repository", "m.*")
    before = Window.partitionBy("row", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("stop") - F.col("size"))
    long = F.char_length("value") >= F.element_at(F.array(*[F.lit(n) for *_, n in KINDS]), F.col("order") + 1)
    extra = F.col("order") == len(BASE)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    found = found.where(long & (~extra | mixed)).withColumn("value", F.sha2("value", 256)).drop("i", "gap", "size")
    row = Window.partitionBy("row").orderBy("start", "order")
    reached = F.max(F.when(~extra, F.col("stop"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(~extra, F.col("start"))).over(row.rowsBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (coming.isNull() | (coming >= F.col("stop")))
    found = found.withColumn("clear", clear).where(~extra | F.col("clear")).drop("clear")
    found = written(found)
    held = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owned = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    # a null owner is one owner
    owned = owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    examples = owned.where(copied).select("value", "owners")
    found = found.join(examples, "value", "left").withColumn("live", F.col("owners").isNull())
    return found.where(~extra | F.col("live")).select("row", "doc_id", "same", "order", "start", "stop", "value", "live")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["order"] + 1), x["start"], x["stop"])), ",")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example of each row of docs.

    spans lists kind:start:stop by start, then kind; base_sha256 is of those of the first three kinds alone.
    n_live and n_example count the spans whose values are live-looking, or copied examples (see `candidates`). Null
    and empty texts have no spans. Repeated rows come back as often and count as one repository. A null
    owner or repository counts as one. Other columns are not read.
    """
    span = F.struct("start", "order", "stop")
    base = F.col("order") < len(BASE)
    some = candidates(docs, repository, owner).groupBy("row", "doc_id", "same").agg(
        *[F.count_if(F.col("order") == k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        _listed(F.collect_list(F.when(base, span))).alias("base"),
        _listed(F.collect_list(span)).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    # rows of one id and text have the same spans
    kept = some.dropDuplicates(["doc_id", "same"]).drop("row").withColumnRenamed("doc_id", "id").withColumnRenamed("same", "hash")
    every = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("hash")), "left").select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example")
    )


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """docs with MASK in place of each live-looking span; spans that overlap become one mask.

    All columns stay; n_chars, where there is one, follows the new text. Copied examples stay. Documents
    without such spans, null texts included, come back as they are. Only documents with spans are shuffled
    by more than their key.
    """
    names = docs.columns
    live = candidates(docs, repository, owner).where("live").select("doc_id", "same", "start", "stop").distinct()
    order = Window.partitionBy("doc_id", "same").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    live = live.withColumn("new", (F.col("start") > reached).cast("int"))
    live = live.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    live = live.groupBy("doc_id", "same", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    id_, same, masked_spans = fresh(names, "masked_id", "masked_same", "masks")
    masks = live.groupBy(F.col("doc_id").alias(id_), F.col("same").alias(same)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(masked_spans))
    text, spans = F.col("text"), F.col(masked_spans)
    end = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    pieces = F.transform(spans, lambda x, i: text.substr((end(i) + 1).cast("int"), (x["start"] - end(i)).cast("int")))
    tail = text.substr((F.element_at(spans, -1)["stop"] + 1).cast("int"), F.char_length(text))
    masked = F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(F.transform(pieces, lambda x: F.concat(x, F.lit(MASK))), ""), tail))
    # documents with masks are few in each partition, and the same plan holds at every size
    hit = docs.join(masks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(same)), "left").withColumn("text", masked)
    if "n_chars" in names:
        hit = hit.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return hit.select(*[quoted(c) for c in names])


def _sql() -> str:
    """The scan in DuckDB's SQL."""
    parts = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        value = f"regexp_extract_all(text, '{p}', {group})"
        parts.append(
            f"select doc_id, source, {k} o, '{kind}' kind, i.i i, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) g, "
            f"list_transform(regexp_extract_all(text, '{p}', 0), lambda x: length(x)) z, {value}[i.i] v, {least} least "
            f"from d, unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) i(i) where regexp_matches(text, '{p}')"
        )
    last = len(BASE)
    names = ", ".join(f"cast(count(*) filter (o = {k}) as bigint) n_{kind}" for k, kind in enumerate(BASE))
    zero = ", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in BASE)
    return f"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
m as ({" union all ".join(parts)}),
s as (select doc_id, source, o, kind, cast(list_sum(g[1:i]) + coalesce(list_sum(z[1:i - 1]), 0) as bigint) a, z[i] n, v from m
  where length(v) >= least and (o < {last} or regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]'))),
t as (select *, a + n b from s),
c as (select * from t x where o < {last} or not exists (select 1 from t y where y.o < {last} and y.doc_id = x.doc_id and y.a < x.b and x.a < y.b)),
w as (select v, count(distinct coalesce(source, chr(1))) owners, count(distinct coalesce(source, chr(1)) || chr(2) || doc_id) repositories from c group by v),
e as (select v, not (owners >= {EXAMPLE_OWNERS} or owners > 1 and repositories >= {EXAMPLE_REPOSITORIES}) live from w),
f as (select c.*, live from c join e using (v) where o < {last} or live),
r as (select doc_id, {names}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, o) filter (o < {last}), '')) base_sha256,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, o) spans, cast(count(*) filter (live) as bigint) n_live, cast(count(*) filter (not live) as bigint) n_example from f group by doc_id)
select d.doc_id, {zero}, coalesce(base_sha256, sha256('')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from d left join r using (doc_id)
"""


SQL = _sql()
