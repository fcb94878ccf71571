"""Personal data: patterns, and information-theoretic sanitisation of the terms that reveal what they found.

Patterns find the protected entities (emails, ip addresses, card and phone numbers; and keys and other secrets, as the long runs of
letters and digits that they are, beside the base kinds). A term discloses an entity as far as knowing the
term tells of the entity: with counts of documents, PMI(term, entity) = log(N n(t,e) / (n(t) n(e))), against all there is to know of
the entity, log(N / n(e)). A term of a document that holds an entity whose share of that exceeds a threshold is generalised to a mark,
and removed beyond a second one: in all documents that hold entities, and in all others too if it is a name by its form, or more than one
text shows it beside the entity. (What a single text shows is gone from that text; an ordinary rare word reveals nothing in others.) The joint count is shrunk by the number of different texts it comes from: one text is
some evidence, so that entities of a single mention have disclosing terms too, and copies of one document are no more than that.

DataFrame and SQL functions only. Scale: patterns run in the scan; texts travel once, to their flagged terms. Only terms rare enough to
disclose are paired with a text's entities; counts cover all documents and are pre-aggregated. Of the documents' words the COMMON most
frequent unflagged ones are dropped where they are read, by a broadcast of their hashes, whatever the corpus's size; so few words travel,
and every document's flagged terms are met."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, temporary

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = len(KINDS), len(KINDS) + 1
NAMES = (*KINDS, "secret", "term")
# The base patterns. Possessive repeats and the look-behind keep them linear on long runs; they match what the plain forms match, as a
# run that fails from its first character fails from any other.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: A text without this has no match of the kind.
_NEEDS = ("@", "[0-9]\\.[0-9]++\\.[0-9]", "[0-9][\\x20-]?[0-9]", "\\+[0-9]")
#: A run of 20 or more of letters, digits, - and _, in which a digit follows a letter three times at least: tokens, digests, keys.
SECRETS = r"(?<![A-Za-z0-9_-])(?=(?:(?:[0-9_-]++|[A-Za-z]++(?![0-9]))*+[A-Za-z]++[0-9]){3})[A-Za-z0-9_-]{20,}+"
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]", "[TERM]")
_WORD = r"\p{L}++"
#: Names by their form: capitalised words inside a sentence or before another such word, and words of scripts without capitals.
_NAME = r"(?<=[^.!?\s]\s)\p{Lu}\p{Ll}++|\p{Lu}\p{Ll}++(?=\s\p{Lu}\p{Ll})|\p{Lo}++"

#: Texts' worth that a joint count loses: of s different texts, (s - DISCOUNT) / s of the count is believed.
DISCOUNT = 0.5
#: Shares of an entity's information beyond which a term is generalised, removed.
GENERALISE, REMOVE = 0.8, 0.95
#: The most frequent unflagged terms, so many at most, whose 64-bit hashes are broadcast.
COMMON = 100_000

_SPAN = "struct<start:int,k:int,end:int,value:string>"


@dataclass(frozen=True)
class Settings:
    discount: float = DISCOUNT
    generalise: float = GENERALISE
    remove: float = REMOVE
    common: int = COMMON


def matches(text: Column, pattern: str, kind: int, keep=lambda value: F.lit(True)) -> Column:
    """Spans of all matches, in code points, end exclusive: the gaps between them (by split) and they themselves, summed up in turn."""
    state = f"struct<pos:int,out:array<{_SPAN}>>"
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("k"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("pos"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out")).cast(state)
    return F.aggregate(F.filter(parts, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_VALID = (
    lambda m: F.lit(True),
    lambda m: m.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"),
    lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    lambda m: F.length(_digits(m)).between(9, 15),
)


def base_spans(text: Column) -> Column:
    """All valid base spans of a text (null: none), by start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = []
    for k, pattern in enumerate(PATTERNS):
        may = F.contains(text, F.lit("@")) if k == 0 else text.rlike(_NEEDS[k])
        found.append(F.when(may, matches(text, pattern, k, _VALID[k])).otherwise(none))
    return F.array_sort(F.concat(*found))


def secret_spans(text: Column, base: Column) -> Column:
    """Spans of secrets that lie in no base span."""
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(SECRETS), _clear(matches(text, SECRETS, SECRET), base)).otherwise(none)


def _clear(spans: Column, of: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(of, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def words(text: Column, pattern: str = _WORD) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def holders(seen: DataFrame) -> DataFrame:
    """(text_key, n, entities, terms, names): each different text with entities, how many documents have it, what it names, its words, and
    those of them that are names by their form."""
    rows = seen.where(F.size("named") > 0)
    entities = F.array_distinct(F.transform("named", lambda m: F.concat_ws(":", m["k"].cast("string"), F.lower(m["value"]))))
    rows = rows.select(F.md5("text").alias("text_key"), entities.alias("entities"), words(F.col("text")).alias("terms"), words(F.col("text"), _NAME).alias("names"))
    return rows.groupBy("text_key").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("entities", "terms", "names")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): in how many documents each term is."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def common_hashes(counts: DataFrame, flagged: DataFrame, most: int) -> DataFrame:
    """Hashes of frequent terms, ``most`` at most, none of which is a flagged term's. The least count is a power of two, from a histogram."""
    size = F.floor(F.log2("n_t")).cast("int")
    histogram = {x["size"]: x["n"] for x in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    least, total = max(histogram, default=0) + 1, 0
    while histogram and least > 0 and total + histogram.get(least - 1, 0) <= most:
        least -= 1
        total += histogram.get(least, 0)
    often = counts.where(F.col("n_t") >= F.lit(2.0**least)).select(F.xxhash64("term").alias("_hash")).distinct()
    return often.join(flagged.select(F.xxhash64("term").alias("_hash")), "_hash", "left_anti")


def disclosing(total: float, counts: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """(term, share, wide): terms whose greatest share of an entity's information, by shrunk counts, exceeds the threshold; ``wide`` ones hold
    in all documents.

    As a joint count is at most the entity's, a share can exceed it only where n(t) <= N^(1 - threshold) n(e)^threshold; other pairs are
    not made. Entities that only one text names all have the same counts with its terms, and stand as one."""
    named = held.select("text_key", "n", F.explode("entities").alias("entity"))
    per_entity = named.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"))
    per_entity = per_entity.where(F.col("n_e") < total).withColumn("most", F.pow(F.lit(total), 1 - settings.generalise) * F.pow("n_e", F.lit(settings.generalise)))
    entity = F.when(F.col("texts") > 1, F.col("entity")).otherwise(F.col("text_key"))
    met = staged(named.join(per_entity, "entity").select("text_key", "n", entity.alias("entity"), "n_e", "most").distinct(), "pii")
    each = F.explode(F.transform("terms", lambda t: F.struct(t.alias("term"), F.array_contains("names", t).alias("name"))))
    rare = held.select("text_key", each.alias("x")).select("text_key", "x.term", "x.name").join(counts, "term").join(met.groupBy("text_key").agg(F.max("most").alias("upto")), "text_key")
    pairs = rare.where(F.col("n_t") <= F.col("upto")).select("text_key", "term", "name", "n_t").join(met, "text_key").where(F.col("n_t") <= F.col("most"))
    joint = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("support"), F.max("name").alias("name"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    together = F.least("n_te", "n_t", "n_e") * (1 - settings.discount / F.col("support"))
    share = F.log(F.lit(total) * together / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(total) / F.col("n_e"))
    wide = F.col("name") | (F.col("support") > 1)
    found = joint.select("term", share.alias("share"), wide.alias("wide")).where(F.col("share") >= settings.generalise)
    return found.groupBy("term").agg(F.max("share").alias("share"), F.max("wide").alias("wide"))


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``base`` (spans of the base patterns), ``named`` (those and the secrets'), ``spans`` (those and the terms', by start,
    then kind) and ``removed`` (terms to leave out).

    Null texts count as empty and have no spans; a document without entities gets the wide terms' alone; repeated rows are treated alike; an
    empty table stays empty; equal shares need no order. Columns of these names in ``docs`` are replaced, other columns stay."""
    docs = docs.drop("base", "named", "spans", "removed", "_terms", "_wide", "_removed", "_key", "_at")
    text, none = F.col("text"), F.array().cast("array<string>")
    seen = docs.withColumn("base", base_spans(text)).withColumn("named", F.array_sort(F.concat("base", secret_spans(text, F.col("base")))))
    with temporary(docs.sparkSession) as keep:
        held = staged(holders(seen), "pii")
        counts = staged(term_counts(docs), "pii")
        flagged = staged(disclosing(float(docs.count()), counts, held, settings), "pii")
        often = common_hashes(counts, flagged, settings.common)
        # keys and words stand before the explode, else they would be made once a word
        rows = docs.select(F.xxhash64("text").alias("_key"), words(text).alias("_words")).select("_key", F.explode("_words").alias("term"))
        rows = rows.withColumn("_hash", F.xxhash64("term")).join(F.broadcast(often), "_hash", "left_anti").drop("_hash").join(flagged, "term")
        marked = F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("wide"), F.col("term"))).alias("_wide"), F.collect_set(F.when(F.col("share") >= settings.remove, F.col("term"))).alias("_removed")
        by_text = staged(rows.groupBy("_key").agg(*marked), "pii")
        keep(by_text)
    # texts of one key would share their lists, which name flagged terms only; a text without words needs no list and goes anywhere
    key = F.when(text.rlike(_WORD), F.xxhash64("text")).otherwise(F.monotonically_increasing_id())
    met = seen.withColumn("_at", key).join(by_text, F.col("_at") == F.col("_key"), "left").drop("_key", "_at")
    met = met.withColumn("_terms", F.when(F.size("named") > 0, F.col("_terms")).otherwise(F.col("_wide")))
    own = _clear(matches(text, _WORD, TERM, lambda m: F.array_contains(F.col("_terms"), F.lower(m))), F.col("named"))
    spans = F.when(F.coalesce(F.size("_terms"), F.lit(0)) > 0, F.array_sort(F.concat("named", own))).otherwise(F.col("named"))
    return met.withColumn("spans", spans).withColumn("removed", F.coalesce("_removed", none)).drop("_terms", "_wide", "_removed")


def sanitised(text: str = "text") -> Column:
    """The text of a row of ``find`` without what its spans cover: marks in place of entities and generalised terms, nothing for removed ones."""
    state = "struct<pos:int,out:string>"
    marks = F.array(*map(F.lit, MARKS))

    def step(acc: Column, x: Column) -> Column:
        gone = (x["k"] == TERM) & F.array_contains(F.col("removed"), F.lower(x["value"]))
        mark = F.when(gone, F.lit("")).otherwise(F.element_at(marks, x["k"] + 1))
        fresh = x["start"] >= acc["pos"]
        upto = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), upto.alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")).cast(state)
    rest = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text) - acc["pos"])))
    return F.when(F.size("spans") > 0, rest).otherwise(F.col(text))
