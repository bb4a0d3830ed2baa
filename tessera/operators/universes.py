"""Universes as bits: one long for each date and symbol, set algebra by bit operations, counts by one aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Universes:
    """Names and their bits, in order; at most 63."""

    names: tuple[str, ...]

    def mask(self, *names: str) -> int:
        return reduce(lambda a, n: a | 1 << self.names.index(n), names, 0)

    def made(self, df: DataFrame, flags: dict[str, Column], name: str = "bits") -> DataFrame:
        """df with the bits of the flags that hold; a missing flag is none."""
        bit = lambda n, c: F.when(F.coalesce(c, F.lit(False)), F.lit(self.mask(n)).cast("long")).otherwise(F.lit(0).cast("long"))
        return df.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), (bit(n, c) for n, c in flags.items())))

    def has(self, bits: Column, all_of: tuple[str, ...] = (), any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = ()) -> Column:
        """Whether the symbol is in all of some universes, in any of others, and in none of the rest."""
        out = F.lit(True)
        if all_of:
            out = out & (bits.bitwiseAND(F.lit(self.mask(*all_of)).cast("long")) == self.mask(*all_of))
        if any_of:
            out = out & (bits.bitwiseAND(F.lit(self.mask(*any_of)).cast("long")) != 0)
        if none_of:
            out = out & (bits.bitwiseAND(F.lit(self.mask(*none_of)).cast("long")) == 0)
        return out

    def derive(self, df: DataFrame, rules: dict[str, dict[str, tuple[str, ...]]], name: str = "bits") -> DataFrame:
        """df with further bits, each by a rule over the bits that stand before it: one projection a rule, no shuffle."""
        for new, rule in rules.items():
            df = df.withColumn(name, F.col(name).bitwiseOR(F.when(self.has(F.col(name), **rule), F.lit(self.mask(new)).cast("long")).otherwise(F.lit(0).cast("long"))))
        return df

    def sizes(self, df: DataFrame, by: list[str], name: str = "bits") -> DataFrame:
        """Members of each universe, and whether some symbol (some, bits) or every one (every, bits) is in it."""
        one = lambda n: F.sum(F.getbit(F.col(name), F.lit(self.names.index(n))).cast("long")).alias(n)
        return df.groupBy(*by).agg(*(one(n) for n in self.names), F.bit_or(name).alias("some"), F.bit_and(name).alias("every"))

    def within(self, value: Column, universe: str, bits: Column) -> Column:
        """The value inside a universe, missing outside."""
        return F.when(self.has(bits, all_of=(universe,)), value)


#: The universes of the daily data, index members first, then what is made of them.
DAILY = Universes(("hs300s", "zz500s", "zz1000s", "zzhls", "stables", "liquid", "liq_div3y", "standards", "top1800s", "universe_A1800_zzhls", "universe_liq_div3y_A1800", "smalls"))
RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "standards": {"all_of": ("stables", "liquid")},
    "top1800s": {"any_of": ("zz1000s", "zz500s", "hs300s")},
    "universe_A1800_zzhls": {"any_of": ("zz1000s", "zz500s", "hs300s", "zzhls")},
    "universe_liq_div3y_A1800": {"any_of": ("liq_div3y", "zz1000s", "zz500s", "hs300s", "zzhls")},
    "smalls": {"all_of": ("standards",), "none_of": ("hs300s", "zz500s")},
}
