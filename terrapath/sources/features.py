"""Feature tables from tiles and parts: tags, types, unions and first copies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unfold_tag(tags: Column, key: str) -> Column:
    """The value of "key"=>"value" in a tag string; null if it is not there."""
    hit = F.regexp_extract(tags, f'"{key}"=>"([^"]*)"', 1)
    return F.when(tags.contains(f'"{key}"=>"'), hit)


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for cond, name in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out


def obstacle_type(building: Column, water: Column, railway: Column, natural: Column) -> Column:
    return first_match([(building.isNotNull(), "building"), (water.isNotNull() | (natural == "water"), "water"), (railway.isNotNull(), "railway"), (natural == "cliff", "cliff")])


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    known = df.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return known.unionByName(df.where(F.col(key).isNull()))


def to_time(x: Column) -> Column:
    """A timestamp in any of the usual notations; null if none fits."""
    # fixed values: the notations, in turn
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in forms])


RANK = {"string": 0, "number": 1, "date": 2, "timestamp": 3}


def family(kind: str) -> str:
    if kind in ("date", "timestamp"):
        return kind
    return "number" if kind.startswith(("int", "bigint", "small", "tiny", "double", "float", "decimal")) else "string"


def unify(parts: Sequence[DataFrame], common_only: bool = True) -> DataFrame:
    """Parts as one table. Columns are those all have, or all there are (missing ones null).

    Where a column's types differ it takes the highest family of timestamp, date, number and string to which
    every value converts without loss, else string. The check reads the parts once."""
    names = [c for c in parts[0].columns if all(c in p.columns for p in parts)] if common_only else list(dict.fromkeys(c for p in parts for c in p.columns))
    casts: dict[str, str] = {}
    for c in names:
        kinds = {dict(p.dtypes)[c] for p in parts if c in p.columns}
        if len(kinds) == 1:
            continue
        top = max((family(k) for k in kinds), key=RANK.get)
        target = {"string": "string", "number": "double", "date": "date", "timestamp": "timestamp"}[top]
        while target != "string" and any(p.where(F.col(c).isNotNull() & convert(F.col(c), target).isNull()).limit(1).count() for p in parts if c in p.columns):
            target = {"timestamp": "double", "date": "double", "double": "string"}[target]
        casts[c] = target
    ready = [p.select(*[convert(F.col(c), casts[c]).alias(c) if c in casts else F.col(c) for c in names if c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)


def convert(x: Column, target: str) -> Column:
    if target == "timestamp":
        return F.coalesce(to_time(x.cast("string")), x.try_cast("timestamp"))
    return x.try_cast(target)


def plain(x: Column) -> Column:
    """Lower case without accents, for comparing labels."""
    return F.lower(F.translate(x, "àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ", "aaaeeeeiioouuucAAAEEEEIIOOUUUC"))


def obstacle_filter(nature: Column, persistence: Column, position: Column) -> Column:
    """Rows that stand in the way: permanent, of some nature, not underground. Unknown values pass."""
    return F.coalesce(plain(persistence).contains("permanent"), F.lit(True)) & ~F.coalesce(plain(nature).contains("sans objet"), F.lit(False)) & F.coalesce(position >= 0, F.lit(True))


def drop_heath(df: DataFrame, code: str) -> DataFrame:
    """Forest types without heath (codes LA4 and LA6)."""
    return df.where(~F.coalesce(F.col(code).isin("LA4", "LA6"), F.lit(False)))


def require_qualified(df: DataFrame, origin: str, qualified: str) -> DataFrame:
    """df, failing when it is read if a detected or mapped road is not qualified."""
    bad = F.col(origin).isin("osm", "detected") & ~F.coalesce(F.col(qualified), F.lit(False))
    return df.where(F.coalesce(F.assert_true(~F.coalesce(bad, F.lit(False)), "roads of origin osm or detected must be qualified first").isNull(), F.lit(True)))
