"""Public suffixes by a rule table, with wildcards and exceptions.

A rule file has one rule a line: ``co.uk``, ``*.ck`` (every label below ``ck``)
or ``!www.ck`` (no suffix although a wildcard says so).  The labels of the
rules, read from the right, form a trie.  Flattened, its nodes are the dotted
endings that rules name; a host has few endings, so walking the trie is an
equi-join of the endings of distinct hosts with the rules.  An exception
prevails over all other rules, otherwise the rule of most labels does.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U


def _ascii_form(names: Column) -> Column:
    """International names as registries store them (``xn--``); what has no such form stays."""
    def encoded(name: str) -> str:
        try:
            return ".".join(label.encode("idna").decode() if label else label for label in name.split("."))
        except UnicodeError:
            return name

    @F.pandas_udf("string")
    def ascii_form(values: pd.Series) -> pd.Series:
        return values.map(encoded)

    return ascii_form(names)


def suffix_rules(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of a rule file to (ending, extra): a host with that ending has a suffix ``extra`` labels longer.

    ``extra`` is 0 for plain rules, 1 for wildcards, -1 for exceptions.  Blank
    lines and lines from ``//`` on are left out, and so is what follows the
    rule on its line.  International rules hold in both spellings.  A wildcard
    that is not the leftmost label is an error.  Repeated rules count once.
    """
    rule = F.lower(F.regexp_extract(F.col(col), r"^\s*(\S*)", 1))
    rules = lines.select(F.regexp_replace(rule, r"\.+$", "").alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    parsed = rules.select(
        F.when(
            F.regexp_replace("rule", r"^\*\.", "").contains("*"),
            F.raise_error(F.concat(F.lit("wildcard that is not the leftmost label: "), "rule")),
        ).when(F.col("rule").startswith("!"), F.substring("rule", 2, 1 << 30))
        .otherwise(F.regexp_replace("rule", r"^\*\.", "")).alias("ending"),
        F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0).alias("extra"),
    )
    plain = F.octet_length("ending") == F.length("ending")
    both = F.when(plain, F.array("ending")).otherwise(F.array("ending", _ascii_form(F.col("ending"))))
    return parsed.select(F.explode(both).alias("ending"), "extra").distinct()


def with_suffix_labels(df: DataFrame, host: str, rules: DataFrame, out: str, unlisted: int = 1) -> DataFrame:
    """Add ``out``: how many trailing labels of ``host`` form its public suffix.

    Addresses, single names and null hosts have none (0); a host that no rule
    names has ``unlisted`` labels (1: its last label, 0: no suffix).  The
    endings are those of distinct hosts; a host of very many rows meets its
    count in a join with a unique side, which adaptive execution splits.
    """
    name = F.lower(F.col(host))
    dotted = F.coalesce(name.contains(".") & ~U.is_ipv4(name), F.lit(False))
    labels = F.split("_host_name", r"\.")
    hosts = df.filter(dotted).select(name.alias("_host_name")).distinct()
    endings = hosts.select("_host_name", F.size(labels).alias("_n"), F.posexplode(labels).alias("_from", "_label"), labels.alias("_labels")).select(
        "_host_name", (F.col("_n") - F.col("_from")).alias("_size"), "_from",
        F.array_join(F.slice("_labels", F.col("_from") + 1, F.col("_n")), ".").alias("ending"),
    )
    met = endings.join(rules, "ending").filter((F.col("extra") < 1) | (F.col("_from") > 0))
    size = F.col("_size") + F.col("extra")
    found = met.groupBy("_host_name").agg(
        F.coalesce(F.max(F.when(F.col("extra") < 0, size)), F.max(size)).alias("_listed")
    )
    counted = df.withColumn("_host_name", name).join(found, "_host_name", "left")
    return counted.select(*df.columns, F.when(dotted, F.coalesce("_listed", F.lit(unlisted))).otherwise(0).alias(out))


def split_host_by(
    df: DataFrame, host: str, rules: DataFrame | None, label: str, suffix: str, subdomains: str, unlisted: int = 1
) -> DataFrame:
    """``urls.split_host`` with the suffixes of a rule table, or the shipped ones without it."""
    if rules is None:
        return U.split_host(df, host, label, suffix, subdomains)
    counted = with_suffix_labels(df, host, rules, "_nsuffix", unlisted)
    return U.split_host(counted, host, label, suffix, subdomains, "_nsuffix").drop("_nsuffix")


def join_public_suffix(urls: DataFrame, rules: DataFrame, unlisted: int = 1) -> DataFrame:
    """Host, subdomain, domain label and suffix of each URL by a rule table (see ``suffix_rules``)."""
    keyed = urls.withColumn("host", U.registry_host(F.col("url")))
    split = split_host_by(keyed, "host", rules, "domain", "suffix", "_subdomains", unlisted)
    taken = F.length("domain") + F.when(F.col("suffix") != "", F.length("suffix") + 1).otherwise(0)
    before = F.length("host") - taken - 1
    subdomain = F.when((F.col("domain") == "") | (before < 1), "").otherwise(F.substr("host", F.lit(1), before))
    return split.select(*urls.columns, "host", subdomain.alias("subdomain"), "domain", "suffix")
