"""Document fingerprints: a Merkle tree over the clauses, paragraphs and sections of a text.

The digest of a leaf is that of its text; a paragraph's is that of its leaves' digests, a section's
that of its paragraphs' and the root's that of all sections'.  A section ends after a paragraph whose
digest begins with CUT, so what is put in or taken out moves no other section's ends.  A fingerprint
is the whole tree, the root in full and the first 8 digits of all other digests:
``root:section;paragraph=leaf leaf|paragraph=leaf/section;paragraph=leaf``.  Equal roots mean equal
texts; where two trees differ, ``with_differing`` goes down the branches that differ, and no others, to
the leaves that were edited.  Two different branches meet in 8 digits once in 2^32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import free_name, stage, text_or_empty

#: A section ends after a paragraph whose digest begins so: after one in 16.
CUT = "0"
#: A leaf ends after marks of a clause, or after 64 characters without one.
LEAF = r"(?s)[^.!?,;:]{0,63}[.!?,;:]+|.{1,64}"


def leaves(paragraph: Column) -> Column:
    """The pieces of a paragraph: nothing is left out between them."""
    return F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _sectioned(items: Column, ends: Column, each) -> Column:
    """``each`` of the items of every section, of which ``ends`` has the last one's number; 0 stands before the first."""
    return F.transform(F.sequence(F.lit(2), F.size(ends)), lambda k: each(F.slice(items, ends[k - 2] + 1, ends[k - 1] - ends[k - 2])))


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the tree of a text column as one string column ``name`` (replaced, where it exists).

    Null counts as empty, which is one empty paragraph; very long texts are one long tree; repeated
    rows get equal trees; an empty table gives an empty one.  All other columns pass through.
    """
    tree, digests, ends = (free_name(df, x) for x in ("_tree", "_digests", "_ends"))
    rows = df.withColumn(tree, F.transform(F.split(text_or_empty(text_col), "\n"), lambda p: F.transform(leaves(p), _md5)))
    rows = rows.withColumn(digests, F.transform(tree, lambda p: _md5(F.array_join(p, ""))))
    last = F.size(digests)
    cut = F.filter(F.sequence(F.lit(1), last), lambda k: (F.col(digests)[k - 1].startswith(CUT)) | (k == last))
    rows = rows.withColumn(ends, F.concat(F.array(F.lit(0)), cut))
    short = lambda d: F.substring(d, 1, 8)
    tops = _sectioned(F.col(digests), F.col(ends), lambda x: _md5(F.array_join(x, "")))
    shown = F.zip_with(digests, tree, lambda d, p: F.concat(short(d), F.lit("="), F.array_join(F.transform(p, short), " ")))
    branches = _sectioned(shown, F.col(ends), lambda x: F.array_join(x, "|"))
    body = F.zip_with(tops, branches, lambda d, x: F.concat(short(d), F.lit(";"), x))
    return rows.withColumn(name, F.concat(_md5(F.array_join(tops, "")), F.lit(":"), F.array_join(body, "/"))).drop(tree, digests, ends)


def sections(print_: Column) -> Column:
    """The branches of a fingerprint: its sections."""
    return F.split(F.substr(print_, F.lit(34)), "/")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def _digest(node: Column) -> Column:
    return F.substring(node["tree"], 1, 8)


def _unequal(a: Column, b: Column) -> Column:
    """Place, from 1, at which two lists of nodes differ; 0 if their digests are equal."""
    return F.array_position(F.zip_with(F.transform(a, _digest), F.transform(b, _digest), lambda x, y: ~x.eqNullSafe(y)), True).cast("int")


def _lacking(a: Column, b: Column) -> Column:
    """Nodes of ``a`` whose digest no node of ``b`` has."""
    return _with(F.transform(b, _digest), lambda known: F.filter(a, lambda x: ~F.array_contains(known, _digest(x))))


def _with_changed(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns of lists of nodes cut down to the nodes whose digest the other lacks.

    Equal beginnings and ends are left out before.  If what is left has the same digests on both
    sides, in another order or number, all of it is changed.  Costs the product of what is left.
    """
    first, last, only_a, only_b = (free_name(df, x) for x in ("_first", "_last", "_only_a", "_only_b"))
    df = df.withColumn(first, _unequal(F.col(a), F.col(b)) - 1)
    ends = _unequal(F.reverse(a), F.reverse(b)) - 1
    df = df.withColumn(last, F.least(ends, F.size(a) - F.col(first), F.size(b) - F.col(first)))
    rest = lambda x: F.when(F.col(first) < 0, F.slice(x, 1, 0)).otherwise(F.slice(x, F.col(first) + 1, F.greatest(F.size(x) - F.col(first) - F.col(last), F.lit(0))))
    df = df.withColumns({a: rest(a), b: rest(b)})
    df = df.withColumns({only_a: _lacking(F.col(a), F.col(b)), only_b: _lacking(F.col(b), F.col(a))})
    moved = (F.size(only_a) == 0) & (F.size(only_b) == 0)
    return df.withColumns({a: F.when(moved, F.col(a)).otherwise(F.col(only_a)), b: F.when(moved, F.col(b)).otherwise(F.col(only_b))}).drop(first, last, only_a, only_b)


def _children(nodes: Column, mark: str) -> Column:
    """The nodes below nodes: (path, tree) with a number more in each path."""

    def below(node: Column) -> Column:
        parts = F.filter(F.split(F.substr(node["tree"], F.lit(10)), mark), lambda x: x != "")
        return F.transform(parts, lambda x, i: F.struct(F.concat(node["path"], F.array(i + 1)).alias("path"), x.alias("tree")))

    return F.flatten(F.transform(nodes, below))


def with_differing(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with what fingerprint ``a`` has and ``b`` doesn't, by descent, as a column ``name`` (replaced, where it exists).

    That is a struct of ``sections``, ``paragraphs``, ``leaves`` and ``compared``, the first three arrays
    of paths, numbers from 1: [section], [section, paragraph] and [section, paragraph, leaf].  Equal
    roots end it at once; children are looked at only below sections, and then paragraphs, that differ.
    ``compared`` counts the nodes of ``a`` looked at, the root among them.  What only ``b`` has is
    found by the reverse.  A null fingerprint gives null; all other columns pass through.
    """
    mine, theirs, out, seen = (free_name(df, x) for x in ("_mine", "_theirs", "_paths", "_seen"))
    unlike = F.substring(a, 1, 32) != F.substring(b, 1, 32)
    tops = lambda x: F.transform(F.when(unlike, sections(F.col(x))).otherwise(F.array().cast("array<string>")), lambda t, i: F.struct(F.array(i + 1).alias("path"), t.alias("tree")))
    rows = df.withColumns({mine: tops(a), theirs: tops(b), out: F.array().cast("array<array<array<int>>>"), seen: F.lit(1).cast("long")})
    for mark in ("[|]", " ", None):
        rows = _with_changed(rows.withColumn(seen, F.col(seen) + F.size(mine)), mine, theirs)
        rows = rows.withColumn(out, F.concat(out, F.array(F.transform(mine, lambda n: n["path"]))))
        if mark:
            rows = rows.withColumns({mine: _children(F.col(mine), mark), theirs: _children(F.col(theirs), mark)})
    found = F.struct(*[F.col(out)[k].alias(x) for k, x in enumerate(("sections", "paragraphs", "leaves"))], F.col(seen).alias("compared"))
    return rows.withColumn(name, F.when(unlike.isNotNull(), found)).drop(mine, theirs, out, seen)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 1) of the sections of ``a`` that ``b`` doesn't have, wherever they stand; none if they are equal."""
    digests = lambda x: F.transform(sections(x), lambda t: F.substring(t, 1, 8))
    return _with(digests(b), lambda known: F.filter(F.transform(digests(a), lambda d, i: F.when(~F.array_contains(known, d), i + 1)), lambda i: i.isNotNull()))


def _leaf_set(print_: Column) -> Column:
    leaves_ = F.regexp_replace(F.substr(print_, F.lit(34)), "[0-9a-f]{8}[;=]", "")
    return F.array_distinct(F.filter(F.split(leaves_, "[ |/]"), lambda d: d != ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves in both fingerprints over those of each; 1 if the roots are equal."""
    la, lb = _leaf_set(a), _leaf_set(b)
    same = F.substring(a, 1, 32) == F.substring(b, 1, 32)
    both, total = F.size(F.array_intersect(la, lb)), F.size(la) + F.size(lb)
    return F.when(same, 1.0).when(total == 0, 0.0).otherwise(2.0 * both / total)


#: Ids that share their quotient by this are neighbours in one bucket.
STRIDE = 256
#: A bucket of more rows than this (repeated ids, or the rows without id) is split by id, by the hash of a row and by chance.
FULL, PARTS, CHANCES = 4096, 1024, 16
#: So many buckets may be put in order by one task.
SINGLE = 4096
#: Bucket of rows without id: below all others.
NO_ID = -(1 << 62)

_KEY = ("bucket", "part", "chance")


def _first(*keys: str) -> list[Column]:
    """The order of rows: descending buckets, then ascending parts of a bucket."""
    return [F.col(keys[0]).desc(), *[F.col(k) for k in keys[1:]]]


def next_bucket(buckets: DataFrame, stride: int = STRIDE) -> DataFrame:
    """For each (bucket, part, chance) the next one in order as ``after``; null at the last.

    Levels of larger buckets keep each ordering task small.
    """
    here = F.struct(*_KEY)
    if buckets.count() <= SINGLE:
        return buckets.select(*_KEY, F.lead(here).over(Window.orderBy(*_first(*_KEY))).alias("after"))
    parent = buckets.withColumn("parent", F.expr(f"floor(bucket / {stride})"))
    wider = parent.select(F.col("parent").alias("bucket"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("chance")).distinct()
    tops = parent.groupBy("parent").agg(F.min_by(here, F.struct(-F.col("bucket"), "part", "chance")).alias("top"))
    own = parent.withColumn("after", F.lead(here).over(Window.partitionBy("parent").orderBy(*_first(*_KEY))))
    over = next_bucket(wider, stride).select(F.col("bucket").alias("p"), F.col("after.bucket").alias("parent")).join(tops, "parent").select("p", "top")
    return own.join(over, own["parent"] == over["p"], "left").select(*_KEY, F.coalesce("after", "top").alias("after"))


def _bucketed(raw: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Rows of (doc_id, _hash ...) with their bucket, part and chance, _hash only in full buckets; the different keys; and what to deal rows by.

    Where part and chance are constants, a plan doesn't see them as keys of its windows, so that rows are dealt by bucket alone.
    """
    bucket = F.coalesce(F.expr(f"floor(doc_id / {STRIDE})"), F.lit(NO_ID))
    sized = stage(raw.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("_n")), "merkle-sizes")
    full = sized.filter(F.col("_n") > FULL).select("bucket", F.lit(True).alias("_full"))
    none = (F.lit(0).cast("long").alias("part"), F.lit(0).alias("chance"))
    if not full.limit(1).count():
        return raw.withColumn("_hash", F.lit(0).cast("long")).select("*", bucket.alias("bucket"), *none), sized.select("bucket", *none), ("bucket",)
    # by id, by the leading bits of the hash, and, as equal rows may come in any order, by chance
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CHANCES)).cast("int")
    split = raw.withColumns({"bucket": bucket, "chance": chance}).join(full, "bucket", "left")
    down = F.coalesce(STRIDE - 1 - F.pmod("doc_id", F.lit(STRIDE)), F.lit(0))
    part = F.when(F.col("_full"), down * PARTS + _leading()).otherwise(0).cast("long")
    split = split.withColumns({"part": part, "chance": F.when(F.col("_full"), F.col("chance")).otherwise(0), "_hash": F.when(F.col("_full"), F.col("_hash")).otherwise(0)}).drop("_full")
    return split, stage(split.select(*_KEY).distinct(), "merkle-buckets"), _KEY


def _leading() -> Column:
    """The first ten bits of the hash: a number below PARTS."""
    return F.shiftrightunsigned("_hash", 54)


def with_next(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", derive=None) -> DataFrame:
    """(doc_id, columns, next_<column>): the values of the next row by descending id, after the last the first's.

    Null ids come last; rows that share an id go by the columns' values, in full buckets by the leading
    bits of their hash, by chance and by the hash.  Rows are shuffled once, by bucket of ids, and stay where they
    are when the first row of the next bucket is joined.  ``derive`` adds columns to rows after they
    are shuffled, once for each row; the first rows of buckets are found without it.  An empty table gives an empty one.
    """
    derive = derive or (lambda df: df)
    given = [c for c in columns if c in docs.columns]
    raw, keys, dealt = _bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"), *given).withColumn("_hash", F.xxhash64(*given)))
    order = Window.partitionBy(*_KEY).orderBy(F.col("doc_id").desc_nulls_last(), "_hash", *given)
    rows = derive(raw.repartition(*dealt)).withColumn("_next", F.lead(F.struct(*columns)).over(order))

    heads = raw.groupBy(*_KEY).agg(F.min(F.struct(-F.col("doc_id"), F.col("_hash"))).alias("_h"))
    heads = stage(heads.select(*[F.col(k).alias(f"_{k}") for k in _KEY], (-F.col("_h.col1")).alias("_id"), F.col("_h._hash").alias("_of")), "merkle-heads")
    same = raw["doc_id"].eqNullSafe(heads["_id"]) & (raw["_hash"] == heads["_of"])
    for k in _KEY:
        same &= raw[k] == heads[f"_{k}"]
    found = raw.join(heads, same, "left_semi").groupBy(*_KEY).agg(F.min(F.struct(*given)).alias("_m"))
    found = derive(found.select(*_KEY, "_m.*"))
    found = found.select(F.struct(*_KEY).alias("_b"), F.struct(*columns).alias("_head"))

    top = keys.orderBy(*_first(*_KEY)).select(F.struct(*_KEY)).head(1)
    highest = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(_KEY, top[0][0], ("long", "long", "int"))]) if top else F.lit(None)
    after = next_bucket(keys).select(*_KEY, F.coalesce("after", highest).alias("_b")).join(found, "_b").select(*_KEY, "_head")
    joined = rows.join(after.hint("merge"), list(_KEY), "left")
    return joined.select("doc_id", *columns, *[F.coalesce(F.col(f"_next.{c}"), F.col(f"_head.{c}")).alias(f"next_{c}") for c in columns])


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text); null texts are empty."""
    return with_next(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), ("text",), id_col)
