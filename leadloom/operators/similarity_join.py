"""A join of names by the similarity of their grams, without a cap.

A name's form is its tokens in order (lower case, letters and digits), and its grams are the
stretches of three characters of the form, repeats told apart by their number; a shorter form
is its only gram. Two forms are similar if the Jaccard similarity of their sets of grams reaches
``least`` (over 0.5).

Grams are ordered by how many forms have them, the rarest first. Of two forms that share ``o``
grams or more the first k shared ones lie among the first n - o + k of each. So forms meet by the
first gram they share, within the prefixes of n - ceil(least * n) + 1; where a gram would make more
than ``hot`` * ``hot`` pairs, by that and the next one they share, and so on. From the second on
the sizes of both forms are part of the key, and give the least overlap ``o``: prefixes are short
and partners few. A key that holds ``o`` grams is not made longer: what meets there is similar.
A pair counts only where it meets by its first shared grams, so it is found once: the grams that each
side passes over before the last of the key have none in common. No key is dropped and no list is too long.

The rows that meet are short: a hash of the key, a number for the form, 128 bits of its grams and the
grams passed over. A gram that one form of two lacks changes at most one bit, so bits that differ in
more places than the grams may leave out most pairs; the rest are compared by their grams.

The join of the keys is never a broadcast: the size of a written table says little of its keys.

There are at most 37^3 stretches of letters, digits and blanks, times the repeats of one in a
name, so the table of grams stays small and is put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.sources.shared import shuffled, written

GRAM = 3
#: Least Jaccard similarity of candidates, and the root of the pairs that a key may make before it is made longer.
LEAST, HOT = 0.7, 100


def form(normal: Column) -> Column:
    """The tokens of a normalised name in order; the same for names that differ in that alone."""
    return F.array_join(F.sort_array(F.split(normal, " ")), " ")


def stretches(forms: Column) -> Column:
    n = F.char_length(forms)
    return F.when(n > GRAM, F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substr(forms, i, F.lit(GRAM)))).otherwise(F.array(forms))


def gram_sets(forms: DataFrame) -> DataFrame:
    """(form, side, grams, low, high) of (form, side): numbers of the grams, the rarest first, and
    their bits. A form's grams stay in its partition."""
    cut = forms.repartition("form").select("form", "side", F.sort_array(stretches(F.col("form"))).alias("all"))
    nth = F.col("place") - F.array_position("all", F.col("gram")) + 2  # among its repeats, which lie side by side
    held = cut.select("form", "side", "all", F.posexplode("all").alias("place", "gram")).select("form", "side", "gram", nth.cast("int").alias("nth"))
    counts = held.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("df"))
    numbers = counts.select("gram", "nth", F.row_number().over(Window.orderBy("df", "gram", "nth")).alias("g"))
    bits = lambda which: F.bit_or(F.expr(f"if(g % 128 div 64 = {which}, shiftleft(1L, g % 64), 0L)"))
    return held.join(F.broadcast(numbers), ["gram", "nth"]).groupBy("form", "side").agg(F.sort_array(F.collect_list("g")).alias("grams"), bits(0).alias("low"), bits(1).alias("high"))


def _least_shared(n: Column, m: Column, least: float) -> Column:
    return F.ceil(least * (n + m) / (1 + least) - 1e-9).cast("int")


ROW = ["side", "id", "grams", "low", "high"]
KEY = ["hash", "l_n", "r_n"]


def _longer(rows: DataFrame, sizes: DataFrame | None, length: int, least: float) -> DataFrame:
    """Rows with one gram more in their key than ``length``: of the next ones as far as the prefix
    reaches. With ``sizes`` (side, other), a row for each size of the other side that is near enough."""
    n = F.size("grams")
    if sizes is not None:
        near = F.least(n, F.col("other")) >= least * F.greatest(n, F.col("other")) - 1e-9
        rows = rows.drop("l_n", "r_n").join(F.broadcast(sizes), "side").where(near)
        rows = rows.withColumns({"l_n": F.when(F.col("side") == 1, n).otherwise(F.col("other")), "r_n": F.when(F.col("side") == 1, F.col("other")).otherwise(n)})
    spare = n - _least_shared(F.col("l_n"), F.col("r_n"), least)  # grams that the other side may lack
    last = spare + length
    rows = rows.where(F.col("at") < last)
    place = F.explode(F.sequence(F.col("at") + 1, last)).alias("at")
    return rows.select(*ROW, "l_n", "r_n", F.col("key").alias("_key"), place).select(*ROW, "l_n", "r_n", F.concat("_key", F.array(F.get("grams", F.col("at")))).alias("key"), "at")


def similar_forms(left: DataFrame, right: DataFrame, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(l_form, r_form, shared) of all similar forms of two tables (form), once each."""
    if not 0.5 < least <= 1:
        raise ValueError("least must lie over 0.5: below, one shared gram may be enough")
    sides = left.select("form", F.lit(1).alias("side")).unionByName(right.select("form", F.lit(2).alias("side"))).where("form <> ''")
    known = written(sides.groupBy("form").agg(F.bit_or("side").alias("side")), "forms")
    sets = written(gram_sets(known).withColumn("id", F.monotonically_increasing_id()), "gram-sets")
    both = F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda s: F.col("side").bitwiseAND(s) > 0)).alias("side")
    sided = sets.select(both, "id", "grams", "low", "high")
    sizes = written(sided.select((3 - F.col("side")).alias("side"), F.size("grams").alias("other")).distinct(), "sizes")  # a row a length of names
    n, none = F.size("grams"), F.lit(0)
    place = F.explode(F.sequence(F.lit(0), n - F.ceil(n * least - 1e-9).cast("int"))).alias("at")
    # the first keys are for forms of all sizes, and no more than there are grams
    firsts = sided.select(*ROW, none.alias("l_n"), none.alias("r_n"), place).withColumn("gram", F.get("grams", F.col("at"))).withColumn("key", F.array("gram"))
    met = written(_met(firsts, ["gram"]).select("gram", (F.col("_a") * F.col("_b") > hot * hot).alias("more")), "met-1")
    rows = firsts.join(F.broadcast(met), "gram")
    cold = rows.where("not more or size(grams) = 1")  # a lone gram is shared with its like alone
    found = written(_pairs(cold, cold, least), "pairs-1")
    sets = sets.select("id", "form", "grams")
    if met.where("more").isEmpty():
        return _checked(found, sets, least)
    keys, length = _longer(rows.where("more and size(grams) > 1"), sizes, 1, least), 2
    while True:
        hashed = keys.withColumn("hash", F.xxhash64("key"))
        more = (F.col("_a") * F.col("_b") > hot * hot) & (_least_shared(F.col("l_n"), F.col("r_n"), least) > length)
        met = written(_met(hashed, KEY).select(*KEY, more.alias("more")), f"met-{length}")
        here = shuffled(hashed.where("side = 1")).join(met.where("not more"), KEY)
        found = found.unionByName(written(_pairs(here, keys, least), f"pairs-{length}"))
        if met.where("more").isEmpty():
            return _checked(found, sets, least)
        rows = written(shuffled(hashed).join(met.where("more").drop("more"), KEY).drop("hash"), f"keys-{length}")
        keys = _longer(rows, None, length, least)
        length += 1


def _met(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys that both sides have, with their rows on each side."""
    return rows.groupBy(*by).agg(F.count_if(F.col("side") == 1).alias("_a"), F.count_if(F.col("side") == 2).alias("_b")).where("_a > 0 and _b > 0")


def _pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Numbers of the forms that meet by a key, where it is the first grams that they share and their bits allow enough."""
    over = F.array_except(F.slice("grams", F.lit(1), F.col("at")), "key")
    side = lambda rows, k, s: rows.where(F.col("side") == k).select(
        F.xxhash64("key").alias("hash"), "l_n", "r_n", F.col("id").alias(s), F.size("grams").alias(f"{s}_size"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"), over.alias(f"{s}_over")
    )
    n, m = F.col("l_size"), F.col("r_size")
    near = F.least(n, m) >= least * F.greatest(n, m) - 1e-9
    differ = F.bit_count(F.col("l_low").bitwiseXOR(F.col("r_low"))) + F.bit_count(F.col("l_high").bitwiseXOR(F.col("r_high")))
    met = shuffled(side(left, 1, "l")).join(side(right, 2, "r"), KEY)
    return met.where((differ <= n + m - 2 * _least_shared(n, m, least)) & near & ~F.arrays_overlap("l_over", "r_over")).select("l", "r")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The forms of the pairs that share enough grams. Keys of one hash may give a pair twice."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("form").alias(f"{s}_form"), F.col("grams").alias(f"{s}_grams"))
    once = pairs.repartition("l").distinct()
    both = shuffled(shuffled(once).join(side("l"), "l")).join(side("r"), "r").withColumn("shared", F.size(F.array_intersect("l_grams", "r_grams")))
    enough = F.col("shared") >= least * (F.size("l_grams") + F.size("r_grams") - F.col("shared")) - 1e-9
    return both.where(enough).select("l_form", "r_form", "shared")
