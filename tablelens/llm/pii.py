"""Personal data: pattern spans, and terms that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Information-theoretic sanitisation adds the terms that give them away.  The
context of an entity is the ``WINDOW`` words before and after it (other entities
left out).  With ``p(k)`` the share of all words that lie in a context of kind
``k`` and ``p(k | t)`` that share among the occurrences of term ``t``, the
pointwise mutual information ``log2(p(k | t) / p(k))`` over the entity's
information content ``-log2 p(k)`` is the part of that content which the term
discloses.  Terms that disclose at least ``generalise_at`` are generalised to
the kind they disclose most, those from ``remove_at`` on are removed.  A term is
counted once per entity value in whose context it stands, so copies of a
document add no evidence; occurrences elsewhere are all counted.

A term needs at least ``min_support`` entity values, whatever the size of the
corpus.  The learned terms stay a table, which grows with the corpus; the
distinct terms of every text are joined to it, and texts get theirs back by
the SHA-256 of the text and a salt from the row's other columns, so copies of a
text are spread over tasks.

Everything is DataFrame expressions.  Long runs of digits, dots or address
characters are matched with possessive loops in linear time and constant
stack.

Defined cases: null text is empty text; empty texts have no spans; spans of
different kinds may overlap and all are returned, by start, then kind; a term
that discloses two kinds alike counts for the first in order; repeated rows
are separate rows; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.spans import add_matches, joined, ranked
from tablelens.llm.util import materialize

# The kinds in order with their patterns.  Possessive loops and
# look-behinds find the same matches as the plain forms: a match can begin
# inside a run of its first characters only where the last match ended.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9]){13,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = "term"
WINDOW = 5  # words of context on either side of an entity
WINDOW_CHARS = 120  # characters in which they are looked for
REMOVE_AT = 0.95
SALTS = 32


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, "\\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        n = F.char_length(_digits(found))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(found)).between(10, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add one column per kind: array<struct<start, end, found>>."""
    for kind in KINDS:
        hint = F.col(text).contains(HINTS[kind]) if kind in HINTS else F.col(text).rlike("[0-9][\\x20-]?[0-9]")
        df = add_matches(df, text, f"__{kind}", PATTERNS[kind], hint)
        df = df.withColumn(kind, F.filter(f"__{kind}", lambda s: _passes(kind, s["found"]))).drop(f"__{kind}")
    return df


def words_in(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def context(text: Column, span: Column) -> Column:
    """Terms among the WINDOW words before and after a span, without entities
    and without a word cut at the far end."""
    start, end = span["start"].cast("int"), span["end"].cast("int")
    low = F.greatest(start - WINDOW_CHARS, F.lit(0))
    before = F.substring(text, low + 1, start - low)
    before = F.when(low > 0, F.regexp_replace(before, "^\\S*", "")).otherwise(before)
    after = F.substring(text, end + 1, F.lit(WINDOW_CHARS))
    after = F.when(F.char_length(after) == WINDOW_CHARS, F.regexp_replace(after, "\\S*$", "")).otherwise(after)
    for kind in KINDS:
        before, after = (F.regexp_replace(c, PATTERNS[kind], " ") for c in (before, after))
    last = F.reverse(F.slice(F.reverse(words_in(before)), 1, WINDOW))
    return F.array_distinct(F.concat(last, F.slice(words_in(after), 1, WINDOW)))


def disclosures(texts: DataFrame, min_support: int = 5) -> DataFrame:
    """(kind, term, n, disclosure) of every term with enough support, over the
    column ``text`` of ``texts``."""
    marked = base_spans(texts.where(F.col("text").rlike("@|[0-9]")), "text")
    entity = F.concat(*[F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["found"].alias("value"), s.alias("at")))
                        for k in KINDS])
    each = marked.withColumn("e", F.explode(entity)).select(
        F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), context(F.col("text"), F.col("e.at")).alias("terms"))
    pairs = each.select("kind", "value", F.explode("terms").alias("term"))
    # a row per kind, value and term that meet; m: in how many contexts
    pairs = materialize(pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("m")))
    kinds = pairs.groupBy("kind").agg(F.count("*").alias("n_kind"), F.sum("m").alias("m_kind"))
    seen = pairs.groupBy("kind", "term").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    counted = materialize(texts.select(F.explode(words_in(F.col("text"))).alias("term")).groupBy("term")
                          .agg(F.count("*").alias("n_term")))
    n_words = counted.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    elsewhere = F.greatest(F.col("n_term") - F.col("m"), F.lit(0))
    plain = F.greatest(F.lit(n_words) - F.col("m_kind"), F.lit(1))
    p_kind = F.col("n_kind") / (F.col("n_kind") + plain)
    p_given = F.col("n") / (F.col("n") + elsewhere)
    known = seen.where(F.col("n") >= min_support).join(F.broadcast(kinds), "kind").join(counted, "term")  # a row a kind
    return known.select("kind", "term", "n", (F.log2(p_given / p_kind) / -F.log2(p_kind)).alias("disclosure"))


def disclosing_terms(texts: DataFrame, min_support: int = 5, generalise_at: float = 0.8) -> DataFrame:
    """(kind, term, disclosure): the terms that disclose enough, each with the
    kind that it discloses most."""
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    best = F.max_by(F.struct("kind", "disclosure"), F.struct("disclosure", -order))
    return (disclosures(texts, min_support).where(F.col("disclosure") >= generalise_at)
            .groupBy("term").agg(best.alias("b")).select("b.kind", "term", "b.disclosure"))


def find(docs: DataFrame, text_col: str = "text", generalise_at: float = 0.8, **options) -> DataFrame:
    """``docs`` plus one span column per kind and ``term`` (start, end, found),
    columns of those names replaced, __text, the text with null as empty, and
    __terms, what its terms disclose (array of term, kind, disclosure)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    learned = materialize(disclosing_terms(docs.select(text.alias("text")), generalise_at=generalise_at, **options))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0)
    keyed = docs.withColumn("__salt", salt).withColumn("__text", text).withColumn(
        "__key", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)))
    one = F.struct("term", "kind", "disclosure")
    mine = (keyed.select("__key", "__salt", F.explode(F.array_distinct(words_in(F.col("__text")))).alias("term"))
            .join(learned, "term").groupBy("__key", "__salt").agg(F.array_sort(F.collect_set(one)).alias("__terms")))
    keyed = keyed.join(mine, ["__key", "__salt"], "left").drop("__key", "__salt")
    out = base_spans(keyed, "__text").withColumn("__terms", F.coalesce("__terms", F.expr(
        "cast(array() as array<struct<term:string,kind:string,disclosure:double>>)")))
    names = F.transform("__terms", lambda t: t["term"])
    pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}])(?iu:"), F.array_join(names, "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    pattern = F.when(F.size("__terms") > 0, pattern).otherwise(F.lit("(?!)"))
    return add_matches(out.withColumn("__pattern", pattern), "__text", TERM, F.col("__pattern"),
                       F.size("__terms") > 0).drop("__pattern")


def all_spans(kinds=(*KINDS, TERM)) -> Column:
    return F.concat(*[ranked(F.col(k), i, k) for i, k in enumerate(kinds)])


def sanitised(found: DataFrame, remove_at: float = REMOVE_AT) -> DataFrame:
    """Result of ``find`` with ``sanitised``: its text with every entity
    replaced by its kind in angle brackets, and every term by the kind that it
    discloses, or by nothing if it discloses ``remove_at`` of it or more.  Of
    overlapping spans the first counts."""
    def tag(span):
        word = F.lower(F.substring(F.col("__text"), (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))
        told = F.get(F.filter("__terms", lambda t: t["term"] == word), F.lit(0))
        kind = F.when(span["kind"] == TERM, F.coalesce(told["kind"], F.lit(TERM))).otherwise(span["kind"])
        name = F.concat(F.lit("<"), F.upper(kind), F.lit(">"))
        return F.when((span["kind"] == TERM) & (told["disclosure"] >= remove_at), F.lit("")).otherwise(name)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("got"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.concat(acc["got"], F.substring(F.col("__text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                 tag(s)).alias("got")))
    rest = lambda acc: F.concat(acc["got"], F.substring(F.col("__text"), (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return found.withColumn("sanitised", F.aggregate(F.array_sort(all_spans()), start, step, rest))
