"""Claiming names: equal content at a name is a duplicate, other content takes a suffix.

A name is tried as it is, then with -2, -3, … before its extension; the first that is free, or
that holds the same bytes already, is taken, in order of arrival. Names are settled without
trying them one by one: the contents of a name are grouped first, so a name that many equal
files share is one row; what the archive holds under a name is one list of taken suffixes; and
the k-th new content gets the k-th suffix that is free.

Two kinds of names depend on the order in which suffixes go: names that are another one's
suffixed form, both in the batch, and names of which the archive has a content behind a gap,
which is a duplicate only if the gap is filled before it comes. These are swept, each name in a
group of its own: its contents and what takes its suffixes meanwhile, in order of arrival,
over a list of free suffixes and an index of the contents held.

- A name meets its suffixed forms at their bare names only, and each of those is taken, at the
  latest, when the first document for it arrives. That moment is known beforehand, so a name
  needs nothing of its suffixed forms' sweeps. They need one thing of its own: whether a
  content of it took their bare name before. So names are swept level by level, names that
  are no suffixed form first; there are as many rounds as suffixes follow on each other.
- Each name that a content is found at or given holds just that content. So of a thousand and
  one contents at least one finds all suffixes taken, and whatever comes later takes none: it
  is looked up among what the suffixes hold in the end, by a join, however many there are. A
  group has a thousand new contents, suffixes held and suffixed forms each, at most.

Defined cases: an empty file equals none, not even itself; nulls in dest are one name each
of their own kind, compared as nulls; rows that share an arrival are one document; an empty
batch claims nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import extension, without_extension
from ..scratch import stored
from ..workers import importable

#: Fixed value: a name is tried with suffixes up to this one.
MOST_SUFFIX = 1000
TOO_MANY = "too many documents claim this name"
_CONTENT = ["dest", "size", "digest", "_own"]


def suffixed(dest: Column, n: Column) -> Column:
    """The n-th name tried for a destination: itself, then -2, -3, … before its extension."""
    return F.when(n == 1, dest).otherwise(F.concat(without_extension(dest), F.lit("-"), n.cast("string"), extension(dest)))


def folder_of(name: Column) -> Column:
    return F.regexp_replace(name, r"/?[^/]*\z", "")


def names_tried(rows: DataFrame, path: str, most: int = MOST_SUFFIX) -> DataFrame:
    """``rows`` with (dest, n) for each destination whose n-th name ``path`` is: itself, and what
    it is a suffixed form of."""
    form = r"\A(.*)-([1-9][0-9]{0,3})(\.[^./]*)?\z"
    name = F.col(path)
    number = F.regexp_extract(name, form, 2)
    bare = rows.where(number != "").withColumn("dest", F.concat(F.regexp_extract(name, form, 1), F.regexp_extract(name, form, 3))).withColumn("n", number.cast("int"))
    bare = bare.where(F.col("n").between(2, most) & (suffixed(F.col("dest"), F.col("n")) == name))
    return rows.withColumn("dest", name).withColumn("n", F.lit(1)).unionByName(bare)


#: What a swept name meets: a suffix that the archive holds, one that another name's document
#: takes on arrival, and a content of its own.
_HELD, _TAKEN, _CONTENT_COMES = 0, 1, 2


def _swept(events: pd.DataFrame, most: int) -> pd.DataFrame:
    """What becomes of a name's contents, n null where all suffixes are taken, and then what its
    suffixes hold."""
    holder: dict[int, tuple] = {}
    first: dict[tuple, int] = {}
    free = 1

    def take(n: int, content: tuple) -> None:
        holder[n] = content
        if content[0] > 0:
            first[content] = min(n, first.get(content, n))

    events = events.assign(_static=events["kind"] != _HELD).sort_values(["_static", "_first", "n"], kind="stable")
    dest, out = events["dest"].iloc[0], []
    for kind, n, size, digest, own, at in zip(events["kind"], events["n"], events["size"], events["digest"], events["_own"], events["_first"], strict=True):
        content = (size, digest)
        if kind != _CONTENT_COMES:
            if n not in holder:
                take(int(n), content)
            elif kind == _HELD and size > 0:
                first[content] = min(int(n), first.get(content, int(n)))
            continue
        while free in holder:
            free += 1
        same = first.get(content, most + 1) if size > 0 else most + 1
        got = min(same, free)
        if got <= most and got == free:
            take(got, content)
        out.append((dest, size, digest, own, at, got if got <= most else None, got == same and got <= most, True))
    out += [(dest, size, digest, None, None, n, True, False) for n, (size, digest) in holder.items()]
    return pd.DataFrame(out, columns=["dest", "size", "digest", "_own", "_first", "n", "found", "comes"]).astype({"n": "Int64"})


def _suffix_pairs(dests: DataFrame, most: int) -> DataFrame:
    """(child, n, parent) of the names that are the n-th form of another one among ``dests``."""
    pairs = names_tried(dests.select(F.col("dest").alias("name")), "name", most).where("n > 1").select(F.col("name").alias("child"), "n", F.col("dest").alias("parent"))
    return pairs.join(dests.select(F.col("dest").alias("parent")), "parent", "left_semi")


def _by_levels(contents: DataFrame, comes: DataFrame, slots: DataFrame | None, hard: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(dest, size, digest, _own, _first, n, found, comes) of the names ``hard``: contents with
    their n, and what suffixes hold. contents: all of the batch; comes: those to be swept."""
    kind = contents.schema["_first"].dataType.simpleString()
    none = F.lit(None)
    event = lambda k, at, own: [F.lit(k).alias("kind"), "dest", F.col("n").cast("int").alias("n"), "size", "digest", at.cast(kind).alias("_first"), own.cast("string").alias("_own")]
    born = contents.groupBy("dest").agg(F.min(F.struct("_first", "size", "digest")).alias("b")).select(F.col("dest").alias("child"), "b.*")
    events = comes.withColumn("n", F.lit(0)).select(*event(_CONTENT_COMES, F.col("_first"), F.col("_own")))
    events = events.unionByName(pairs.join(born, "child").withColumnRenamed("parent", "dest").select(*event(_TAKEN, F.col("_first"), none)))
    if slots is not None:
        events = events.unionByName(slots.select(*event(_HELD, none, none)))
    events = stored(events.join(hard, "dest", "left_semi"), "claims-events")
    level = stored(hard.join(pairs.select(F.col("child").alias("dest")), "dest", "left_anti"), "claims-level")
    schema = f"dest string, size long, digest string, _own string, _first {kind}, n int, found boolean, comes boolean"
    out = given = None
    while level.limit(1).count():
        now = events.join(level, "dest", "left_semi")
        if given is not None:
            now = now.unionByName(given.join(level, "dest", "left_semi"))
        swept = stored(now.groupBy("dest").applyInPandas(lambda pdf: _swept(pdf, most), schema), "claims-swept")
        out = swept if out is None else out.unionByName(swept)
        below = pairs.join(level.select(F.col("dest").alias("parent")), "parent", "left_semi")
        took = swept.where("comes AND NOT found AND n > 1").select(F.col("dest").alias("parent"), "n", "size", "digest", "_first")
        given = took.join(below, ["parent", "n"]).select(F.lit(_TAKEN).alias("kind"), F.col("child").alias("dest"), F.lit(1).alias("n"), "size", "digest", "_first", none.cast("string").alias("_own"))
        level = stored(below.select(F.col("child").alias("dest")).distinct(), "claims-level")
    return out


def claim(rows: DataFrame, archive: DataFrame | None = None, arrival: str = "arrival", most: int = MOST_SUFFIX) -> DataFrame:
    """Add final_dest, duplicate and claim_error to rows with dest, size, digest and ``arrival``,
    which tells rows apart and orders them. ``archive`` (path, size, digest) holds what is
    filed already; only names that rows may try count. ``most`` is the last suffix tried."""
    importable(rows.sparkSession)
    own = F.when(F.col("size") > 0, F.lit("")).otherwise(F.col(arrival).cast("string"))
    rows = rows.withColumn("_own", own)
    contents = stored(rows.groupBy(*_CONTENT).agg(F.min(arrival).alias("_first")), "claims-contents")
    dests = contents.select("dest").distinct()
    pairs = _suffix_pairs(dests, most)
    in_order = pairs.limit(1).count() > 0
    if in_order:
        pairs = stored(pairs, "claims-pairs")
    linked = pairs.select(F.col("child").alias("dest")).unionByName(pairs.select(F.col("parent").alias("dest"))).distinct()
    if archive is None:
        fresh, settled, slots, taken, hard = contents, None, None, None, linked
    else:
        slots = stored(names_tried(archive.select("path", "size", "digest"), "path", most).join(dests, "dest", "left_semi"), "claims-slots")
        taken = slots.groupBy("dest").agg(F.collect_set("n").alias("taken"))
        taken = taken.select("dest", F.array_except(F.sequence(F.lit(1), F.lit(most)), F.col("taken")).alias("free"))
        there = slots.where("size > 0").groupBy("dest", "size", "digest").agg(F.min("n").alias("n")).join(taken, "dest")
        there = there.select("dest", "size", "digest", "n", (F.col("n") > F.coalesce(F.get("free", F.lit(0)), F.lit(most + 1))).alias("behind"))
        met = contents.join(there, ["dest", "size", "digest"], "left")
        settled, fresh = met.where("n IS NOT NULL"), met.where("n IS NULL").drop("n", "behind")
        hard = linked.unionByName(settled.where("behind").select("dest")).distinct()
    if in_order or archive is not None:
        hard = stored(hard, "claims-hard")
        in_order = hard.limit(1).count() > 0

    # more new contents than suffixes can't be named, so only the first of a name are ranked
    order = Window.partitionBy("dest").orderBy("_first", "digest")
    ranked = fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    given = [*_CONTENT, "_first", "final_dest", "found"]
    easy = (lambda df: df.join(hard, "dest", "left_anti")) if in_order else (lambda df: df)
    sure = easy(ranked).withColumn("found", F.lit(False))
    if taken is not None:
        sure = sure.join(taken, "dest", "left").withColumn("n", F.when(F.col("free").isNull(), F.col("n")).otherwise(F.get("free", F.col("n") - 1))).drop("free")
        sure = sure.unionByName(easy(settled).drop("behind").withColumn("found", F.lit(True)))
    named = sure.withColumn("final_dest", suffixed(F.col("dest"), F.col("n"))).select(*given)
    if in_order:
        comes = ranked.drop("n") if settled is None else ranked.drop("n").unionByName(settled.drop("n", "behind"))
        comes = stored(comes.join(hard, "dest", "left_semi"), "claims-comes")
        swept = _by_levels(contents, comes, slots, hard, pairs, most)
        # what comes when all suffixes are taken is only looked up
        late = contents.where("size > 0").join(hard, "dest", "left_semi").join(comes.select(*_CONTENT), _CONTENT, "left_anti")
        held = swept.where("NOT comes AND size > 0").groupBy("dest", "size", "digest").agg(F.min("n").alias("n"))
        late = late.join(held, ["dest", "size", "digest"]).withColumn("found", F.lit(True))
        both = swept.where("comes").drop("comes").unionByName(late.select(*_CONTENT, "_first", "n", "found"))
        named = named.unionByName(both.withColumn("final_dest", suffixed(F.col("dest"), F.col("n"))).select(*given))
    out = rows.join(named, _CONTENT, "left")
    again = F.col("found") | ((F.col("size") > 0) & (F.col(arrival) > F.col("_first")))
    return (
        out.withColumn("duplicate", F.coalesce(F.col("final_dest").isNotNull() & again, F.lit(False)))
        .withColumn("claim_error", F.when(F.col("final_dest").isNull(), F.lit(TOO_MANY)))
        .drop("_own", "_first", "found")
    )
