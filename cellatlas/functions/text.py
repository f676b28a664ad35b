"""Query texts: tokens, gene names, classes of queries, and how names resemble each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CLUSTER_ALIASES, GENE_PATTERN, GENE_PREFIXES, ORDINARY_WORDS

# What is stripped off a token, and the shares of a query's tokens that decide its mode.
TOKEN_EDGES = ".,;:()"
GENE_SHARE, MIXED_SHARE = 0.6, 0.2


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """White-space tokens without the punctuation at their ends, in upper case; empty ones are dropped."""
    parts = F.transform(F.split(trimmed(text), r"\s+"), lambda t: F.upper(F.btrim(t, F.lit(TOKEN_EDGES))))
    return F.filter(parts, lambda t: t != "")


def n_tokens(text: Column) -> Column:
    """White-space tokens, also those of punctuation only."""
    return F.size(F.filter(F.split(trimmed(text), r"\s+"), lambda t: t != ""))


def gene_like(token: Column, prefixes: Sequence[str] = GENE_PREFIXES) -> Column:
    """By its form: the pattern, and a known prefix or a digit in three characters or more."""
    prefix = F.lit(False)
    for p in prefixes:
        prefix = prefix | token.startswith(p)
    return token.rlike(GENE_PATTERN) & (prefix | (token.rlike("[0-9]") & (F.length(token) >= 3)))


def query_mode(text: Column, universe: Column, prefixes: Sequence[str] = GENE_PREFIXES, ordinary: Sequence[str] = ORDINARY_WORDS) -> Column:
    """gene_list, mixed or ontology, by the shares of gene tokens and ordinary words among all tokens.

    universe: an array of gene names in upper case, of the size of a gene list.
    """
    words = F.array(*[F.lit(w.upper()) for w in ordinary]) if ordinary else F.array().cast("array<string>")
    def share(of: Column) -> Column:
        return F.size(of) / F.greatest(n_tokens(text), F.lit(1))

    plain = F.filter(tokens(text), lambda t: F.array_contains(words, t))
    genes = F.filter(tokens(text), lambda t: ~F.array_contains(words, t) & (F.array_contains(universe, t) | gene_like(t, prefixes)))
    return F.when(share(genes) >= GENE_SHARE, "gene_list").when((share(genes) >= MIXED_SHARE) & (share(plain) >= MIXED_SHARE), "mixed").otherwise("ontology")


def gene_names(text: Column, universe: Column, ordinary: Sequence[str] = ORDINARY_WORDS) -> Column:
    """Tokens of the universe, or of a gene's form and no ordinary word; in order, repeats kept."""
    words = F.array(*[F.lit(w.upper()) for w in ordinary]) if ordinary else F.array().cast("array<string>")
    return F.filter(tokens(text), lambda t: F.array_contains(universe, t) | (t.rlike(GENE_PATTERN) & ~F.array_contains(words, t)))


def parsed(queries: DataFrame, universe: DataFrame, prefixes: Sequence[str] = GENE_PREFIXES, ordinary: Sequence[str] = ORDINARY_WORDS) -> DataFrame:
    """qid, mode and genes of query texts (qid, text), as query_mode and gene_names define them; each qid is there once.

    universe: gene_u, names in upper case, of any number; tokens meet them by a join. A text that is null or has no
    token is an ontology query without genes.
    """
    known = universe.select(F.col("gene_u").alias("_t")).distinct().withColumn("_known", F.lit(True))
    own = queries.select("qid", F.posexplode(tokens(F.col("text"))).alias("_i", "_t")).join(known, "_t", "left")
    token, found = F.col("_t"), F.coalesce("_known", F.lit(False))
    plain = token.isin([w.upper() for w in ordinary])
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    named = F.when(found | (token.rlike(GENE_PATTERN) & ~plain), F.struct("_i", "_t"))
    each = own.groupBy("qid").agg(count(~plain & (found | gene_like(token, prefixes))).alias("_g"), count(plain).alias("_l"), F.sort_array(F.collect_list(named)).alias("_n"))
    share = lambda n: F.coalesce(n, F.lit(0)) / F.greatest(n_tokens(F.coalesce("text", F.lit(""))), F.lit(1))
    mode = F.when(share("_g") >= GENE_SHARE, "gene_list").when((share("_g") >= MIXED_SHARE) & (share("_l") >= MIXED_SHARE), "mixed").otherwise("ontology")
    genes = F.coalesce(F.transform("_n", lambda x: x["_t"]), F.array().cast("array<string>"))
    return queries.select("qid", "text").join(each, "qid", "left").select("qid", mode.alias("mode"), genes.alias("genes"))


def mentioned(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(trimmed(F.lower(x)), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Common words of two names by all their words; 0 where neither has a word."""
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.greatest(both, F.lit(1)))


def alike(a: Column, b: Column, least: float = 0.5) -> Column:
    """One name holds the other, or they share half of their words. An empty name is like none."""
    x, y = trimmed(F.lower(a)), trimmed(F.lower(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (jaccard(a, b) >= least))


def plain_name(x: Column) -> Column:
    """Lower case, - and _ as spaces."""
    return F.translate(F.lower(x), "-_", "  ")


def name_parts(x: Column) -> Column:
    """Parts of a name that are longer than three characters."""
    return F.filter(F.split(plain_name(x), r"\s+"), lambda t: F.length(t) > 3)


def name_boost(cluster: Column, query: Column, boost: float = 0.15, over: float = 0.3) -> Column:
    """boost times the share of the name's parts that the query contains, if that share is over `over`; else 0."""
    parts = name_parts(cluster)
    ratio = F.size(F.filter(parts, lambda p: F.lower(query).contains(p))) / F.greatest(F.size(parts), F.lit(1))
    return F.when(ratio > over, F.lit(boost) * ratio).otherwise(F.lit(0.0))


def covered(text: Column, keywords: Column) -> Column:
    """Whether the text has any of the keywords, whatever their case."""
    return F.exists(keywords, lambda k: F.lower(text).contains(F.lower(k)))


def short_name(x: Column, most: int = 25, names: Mapping[str, str] | None = None) -> Column:
    """A name to display: the one that `names` has for it, else at most `most` characters, cut names ending in a dot."""
    if names:
        table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
        return F.coalesce(F.element_at(table, x), short_name(x, most))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("."))).otherwise(x)


def synonyms(cluster: Column, rules: Mapping[str, Sequence[str]] = CLUSTER_ALIASES) -> Column:
    """The name, its rule's names and what stands before its first comma, each once, sorted."""
    own = F.array().cast("array<string>")
    for name, others in rules.items():
        own = F.when(cluster == name, F.array(*[F.lit(x) for x in others])).otherwise(own)
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(cluster, trimmed(F.split(cluster, ",")[0])), own), lambda s: s != "")))


def base_id(ensembl: Column) -> Column:
    """Without the version behind the dot."""
    return F.split(ensembl, r"\.")[0]


def percent_text(value: Column, share: Column) -> Column:
    """The value and its share in whole percent, halves to the even one."""
    return F.concat(value, F.lit(" ("), F.rint(share * 100).cast("int").cast("string"), F.lit("%)"))




def _any_of(pairs: Mapping[str, Sequence[str]], is_key, hit) -> Column:
    found = F.lit(False)
    for name, others in pairs.items():
        for other in others:
            found = found | (is_key(name) & hit(other))
    return found


def pathways_alike(a: Column, b: Column, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """One name holds the other, they share two words, or a holds a name of `aliases` and b one of its other forms."""
    x, y = F.translate(F.lower(a), "-/", "  "), F.translate(F.lower(b), "-/", "  ")
    other = _any_of(aliases or {}, lambda name: x.contains(name.lower()), lambda form: y.contains(form.lower()))
    return (trimmed(x) != "") & (trimmed(y) != "") & (x.contains(y) | y.contains(x) | (F.size(F.array_intersect(words(x), words(y))) >= 2) | other)


def clusters_alike(a: Column, b: Column, aliases: Mapping[str, Sequence[str]] | None = None, common: Sequence[str] = ("like", "cells", "cell", "type", "the", "and", "of")) -> Column:
    """One name (or one of a's aliases) holds the other, or they share a word that isn't common."""
    x, y = trimmed(F.lower(a)), trimmed(F.lower(b))
    other = _any_of(aliases or {}, lambda name: a == name, lambda form: y.contains(form.lower()) | F.lit(form.lower()).contains(y))
    split = lambda n: words(F.translate(n, "-+_", "   "))
    shared = F.array_except(F.array_intersect(split(x), split(y)), F.array(*[F.lit(w) for w in common]))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | other | (F.size(shared) > 0))


def digits_first(x: Column) -> list[Column]:
    """An order in which names of digits only come first; each part by its characters."""
    return [~x.rlike("^[0-9]+$"), x]
