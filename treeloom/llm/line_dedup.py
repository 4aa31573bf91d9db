"""Line dedup by an exact set-similarity join (operator 3), in DataFrame operations only.

A line's tokens are its different words. A line goes if an earlier one (by document id,
then line number) has a Jaccard similarity of at least ``num / den`` with it.

* Equal lines are found by grouping two hashes; only first occurrences go on.
* Tokens are ordered by rarity: their documents' counts are kept in a table of fixed size,
  by hash, so that ordering them needs no join. Any order of this kind is the same for all
  lines, which is all that prefix filtering asks for.
* The prefixes are joined on tokens, under length, positional and bitmap filters. All are
  upper bounds of the overlap, so no similar pair is missed. The bitmap of a line has a
  bit flipped for each token; bits that differ bound the tokens that do.
* Semi-joins keep one row for a line's token however many partners it has there, so large
  groups of near copies never make their pairs. Three of them follow each other: slim rows
  find the lines that may have a partner, and on which tokens; rows of those that also have
  the whole prefix keep the first token that two lines share, as one meeting is enough; and
  only those rows carry the text, compare words, and end a line's search at its first match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the rarity table. It has one byte for each slot, at any size of input.
SLOTS = 1 << 17
#: Slots that are counted side by side in one row, so that a task's counts stay few rows.
BESIDE = 4
#: The greatest size that has room in a posting; it stands for all greater ones as well.
MOST = (1 << 16) - 1
#: Lines of more tokens have bitmaps of 64 bits of all tokens and of half of them.
WIDE = 90
SPACE = r"[\x20\x09-\x0D]+"
#: White space other than blanks and line feeds.
OTHER_SPACE = "\t\r\x0b\x0c"


def _split(text: Column, plain: Column | None = None) -> Column:
    """The words of a text, with empty ones among them. Few texts have white space other than
    blanks (``plain``, if given, is the text with blanks as its line feeds); to look for it,
    and to split at a blank, takes no regular expression."""
    other = reduce(or_, (F.contains(text, F.lit(c)) for c in OTHER_SPACE))
    return F.when(other, F.split(text, SPACE)).otherwise(F.split(text if plain is None else plain, " "))


def _words(line: Column) -> Column:
    return F.array_remove(_split(line), "")


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(f" \n{OTHER_SPACE}")) != ""


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row, not at each use of them."""
    made = F.struct(*(c.alias(k) for k, c in columns.items()))
    out = df.select("*", F.explode(F.array(made)).alias("__made"))
    return out.select(*df.columns, *(F.col("__made")[k].alias(k) for k in columns))


def rarity(docs: DataFrame) -> Column:
    """The level of each slot's count, 3 for each doubling, as one array.

    It is a scalar subquery, so it is computed once and never part of a plan's text. Every
    slot is counted once more than its words, so that none is missing.
    """
    words = docs.select(F.explode(_split(F.col("text"), F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''").select(_slot(F.xxhash64("w")).alias("slot"))
    beside = [f"n{k}" for k in range(BESIDE)]
    words = words.groupBy(F.expr(f"slot div {BESIDE}").cast("int").alias("row")).agg(*(F.count_if(F.col("slot") % BESIDE == k).alias(n) for k, n in enumerate(beside)))
    # Slots are added to the counts and not to the words, whose rows would leave generated code.
    every = docs.sparkSession.range(SLOTS // BESIDE).select(F.col("id").cast("int").alias("row"), *(F.lit(1).cast("long").alias(n) for n in beside))
    counts = words.unionByName(every).groupBy("row").agg(*(F.sum(n).alias(n) for n in beside))
    level = F.array(*(F.least(F.lit(127), F.floor(3 * F.log2(n))).cast("tinyint") for n in beside))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("row", level.alias("level")))).alias("levels"))
    return table.select(F.flatten(F.transform("levels", lambda x: x["level"])).alias("levels")).scalar()


def _key(hashed: Column, levels: Column) -> Column:
    """A token as a number: its level above 56 bits of its hash, so that rare ones are less."""
    level = F.coalesce(F.get(levels, _slot(hashed)), F.lit(0).cast("tinyint"))
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 56) - 1)))


def _postings(lines: DataFrame, place: list[str], levels: Column, num: int, den: int) -> DataFrame:
    """Lines with what filters need: the prefix of their tokens' keys, in order, their size,
    and bitmaps. The prefix of n tokens is as long as lets a similar line avoid the rest."""
    # The table's column has a single use in the next projection, into which it is merged;
    # rows never carry it.
    hashes = F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))  # apart, as a key uses one several times
    keys = F.sort_array(F.array_distinct(F.transform(hashes, lambda h: _key(h, F.col("__levels")))))
    sized = lines.withColumn("__levels", levels).select(*place, keys.alias("keys"))
    size = F.size("keys")
    needed = F.ceil(size * float(num) / den - 1e-9).cast("int")  # of an equal overlap
    # A token flips one bit of 64. As these leave too little to tell long lines apart, such a
    # line has a second bitmap, of the tokens that one bit of their keys picks.
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(bit(k)))
    picked = F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0)
    return _computed(sized, n=size, bits=word(F.col("keys")), bits2=F.when(size > WIDE, word(picked)), prefix=F.slice("keys", F.lit(1), size - needed + 1)).drop("keys")


def _spot(token: Column, n: Column, at: Column) -> Column:
    """A token's half key, the line's size and the token's place in one number, as such rows
    are many: 32, 16 and 16 bits. A size too great for that makes filters let the row pass."""
    most = F.lit(MOST)
    sizes = F.shiftleft(F.least(n, most), 16).bitwiseOR(F.least(at, most)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(token, 32).bitwiseOR(sizes)


def _may_match(num: int, den: int) -> str:
    """Of lines x and y that share a token: whether they can be similar."""
    differ = """CASE WHEN x.bits2 IS NULL OR y.bits2 IS NULL THEN bit_count(x.bits ^ y.bits)
        ELSE bit_count(x.bits ^ x.bits2 ^ y.bits ^ y.bits2) + bit_count(x.bits2 ^ y.bits2) END"""
    n, at = "((shiftright({0}.spot, 16)) & 65535)", "({0}.spot & 65535)"
    x, y = n.format("x"), n.format("y")
    rest = f"least({x} - {at.format('x')}, {y} - {at.format('y')})"  # tokens from this one on
    return f"""({x} = {MOST} OR {y} = {MOST} OR {den} * least({x}, {y}) >= {num} * greatest({x}, {y})
        AND {num + den} * {rest} >= {num} * ({x} + {y})
        AND {num + den} * ({x} + {y} - {differ}) >= {2 * num} * ({x} + {y}))"""


def _before(y: str, x: str, place: list[str]) -> str:
    """Whether the line ``y`` comes before the line ``x``."""
    return f"struct({', '.join(f'{y}.{c}' for c in place)}) < struct({', '.join(f'{x}.{c}' for c in place)})"


def _others(place: list[str]) -> str:
    return f"NOT ({' AND '.join(f'x.{c} = y.{c}' for c in place)})"


def _by_document(lines: DataFrame, key: list[str], name: str, *more: str) -> DataFrame:
    return lines.groupBy(*key).agg(F.collect_list(F.struct("no", *more)).alias(name))


def _picked(docs: DataFrame, key: list[str], lines: DataFrame, *more: str) -> DataFrame:
    """The lines of documents that ``lines`` lists as ``nos``: structs that have ``no``."""
    rows = _computed(docs.join(lines, key), lines=F.split("text", "\n")).select(*key, "lines", "nos")
    picked = rows.select(*key, F.explode(F.transform("nos", lambda x: F.struct(x.alias("x"), F.get(F.col("lines"), x["no"]).alias("line")))).alias("p"))
    return picked.select(*key, F.col("p.x.no").alias("no"), *(F.col(f"p.x.{k}").alias(k) for k in more), "p.line")


def removed_lines(docs: DataFrame, key: list[str], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """First occurrences of different lines, by document as ``nos``, and those of them that
    are similar to an earlier line, as the document's key and ``no``."""
    place = [*key, "no"]
    lines = docs.select(*key, F.posexplode(F.split("text", "\n")).alias("no", "line")).where(has_word(F.col("line")))
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct(*place).alias("at"))
    first = _by_document(hashed.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("at.*"), key, "nos")
    levels = rarity(docs)
    may, bits = _may_match(num, den), ["bits", "bits2"]
    half = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))  # tokens that share it by chance are told apart later
    rows = _postings(_picked(docs, key, first), place, levels, num, den).select(*place, "n", *bits, F.posexplode("prefix").alias("at", "key"))
    slim = rows.select(_spot(half, F.col("n"), F.col("at")).alias("spot"), *bits, *place)
    met = slim.alias("x").join(slim.alias("y"), F.expr(f"shiftrightunsigned(x.spot, 32) = shiftrightunsigned(y.spot, 32) AND {_others(place)} AND {may}"), "left_semi")
    met = met.select(*place, F.shiftrightunsigned("spot", 32).alias("token"))
    # Lines that met, each once, with the tokens at which they did. Similar lines met at the
    # first token that they share, so one looks for an earlier one among those alone.
    lists = _by_document(met.groupBy(*place).agg(F.collect_list("token").alias("tokens")), key, "nos", "tokens")
    rows = _postings(_picked(docs, key, lists, "tokens"), [*place, "tokens"], levels, num, den)
    rows = _computed(rows, shared=F.filter("prefix", lambda k: F.array_contains("tokens", k.bitwiseAND(F.lit(0xFFFFFFFF)))))
    rows = rows.select(*place, "n", *bits, "prefix", "shared", F.posexplode("shared").alias("k", "key"))
    wide = rows.select("key", _spot(half, F.col("n"), (F.array_position("prefix", F.col("key")) - 1).cast("int")).alias("spot"), *place, *bits, F.coalesce(F.slice("shared", F.lit(1), F.col("k")), F.array().cast("array<long>")).alias("earlier"))
    meant = wide.alias("x").join(wide.alias("y"), F.expr(f"x.key = y.key AND {_others(place)} AND {may} AND NOT arrays_overlap(x.earlier, y.earlier)"), "left_semi").select(*place, "key")
    lists = _by_document(meant.groupBy(*place).agg(F.collect_list("key").alias("keys")), key, "nos", "keys")
    # The lines' different words are dealt as one text, which is smaller than they are as an array.
    words = F.array_distinct(_words(F.col("line")))
    # Columns stand as they come from the last step, so both sides are the same and dealt once.
    texts = _computed(_picked(docs, key, lists, "keys"), words=words).select(*place, F.array_join("words", " ").alias("line"), F.size("words").alias("n"), F.explode("keys").alias("key"))
    alike = f"{num + den} * size(array_intersect(split(x.line, ' '), split(y.line, ' '))) >= {num} * (x.n + y.n)"
    similar = texts.alias("x").join(texts.alias("y"), F.expr(f"x.key = y.key AND {_before('y', 'x', place)} AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND {alike}"), "left_semi")
    return first, similar.select(*place).distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and the ``text`` that is left of each row.

    Lines without a word are kept and match nothing. A null text stays null, with 0 lines;
    an empty one is one line without a word. Null ids come first in the order of documents,
    as the least long does. Rows of equal id are in order of a hash of their texts, and
    repeated rows (same id and text) are one document: each of them is left with the same
    lines. A document may end with an empty text. Columns to keep are returned in a struct
    ``kept``; others are not read.
    """
    least = -(1 << 63)
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    # Texts have a part in the order only where ids repeat, or the least long is one.
    counts = df.groupBy(number.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.col(id_col)).alias("own"))
    repeated = not counts.where((F.col("n") > 1) | (F.col("id") == least) & (F.col("own") > 0)).isEmpty()
    key = ["id", "tie"] if repeated else ["id"]
    tie = F.concat(F.when(F.col(id_col).isNull(), "0").otherwise("1"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")))
    kept_columns = [F.struct(*keep).alias("kept")] if keep else []
    docs = df.select(number.alias("id"), *([tie.alias("tie")] if repeated else []), F.col(text_col).cast("string").alias("text"), *(kept_columns if repeated else []))
    # All that deals texts takes the same columns, so that they are dealt once.
    first, similar = removed_lines(docs.select(*key, "text"), key, num, den)
    kept = first.join(_by_document(similar, key, "gone"), key, "left")
    kept = kept.select(*key, F.coalesce(F.array_except("nos.no", "gone.no"), "nos.no").alias("nos"))
    rows = _computed(docs.join(kept, key, "left"), lines=F.split("text", "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~has_word(F.get(F.col("lines"), i)))
    none = F.array().cast("array<int>")
    if keep and not repeated:
        # Joined by id at the end, they leave the dealt texts the same for all uses.
        rows = rows.join(df.select(number.alias("id"), *kept_columns), "id")
    rows = _computed(rows, order=F.sort_array(F.concat(F.coalesce("nos", none), F.coalesce(blank, none))))
    return rows.select(
        F.when(~F.col("tie").startswith("0") if repeated else F.col("id") != least, F.col("id")).alias("doc_id"),
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        (F.greatest(F.size("lines"), F.lit(0)) - F.size("order")).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join(F.transform("order", lambda i: F.get(F.col("lines"), i)), "\n")).alias("text"),
        *(["kept"] if keep else []),
    )


def op3(docs: DataFrame) -> DataFrame:
    """All ``documents`` without lines that are similar to an earlier one."""
    return dedup_lines(docs)


#: The same rows in DuckDB SQL, by prefix filtering with exact counts of tokens.
SQL = r"""
WITH rows_ AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM rows_),
worded AS (SELECT doc_id, no, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sets AS (SELECT list_sort(w) AS w, min(row(doc_id, no)) AS spot FROM worded GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY spot) AS k, w, len(w) AS n FROM sets),
tokens AS (SELECT k, n, unnest(w) AS t FROM numbered),
counts AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
placed AS (SELECT k, n, t, row_number() OVER (PARTITION BY k ORDER BY c, t) AS p FROM tokens JOIN counts USING (t)),
prefix AS (SELECT * FROM placed WHERE p <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (SELECT DISTINCT x.k AS a, y.k AS b FROM prefix x JOIN prefix y ON x.t = y.t AND y.k < x.k AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
alike AS (SELECT DISTINCT a FROM pairs JOIN numbered x ON x.k = a JOIN numbered y ON y.k = b WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
firsts AS (SELECT s.spot FROM numbered JOIN sets s USING (w) WHERE k NOT IN (SELECT a FROM alike)),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM lines l
  WHERE NOT regexp_matches(l.line, '[^\x20\x09-\x0D]') OR row(l.doc_id, l.no) IN (SELECT spot FROM firsts) GROUP BY l.doc_id)
SELECT r.doc_id, coalesce(len(r.lines), 0) AS n_lines, coalesce(len(r.lines), 0) - coalesce(k.n, 0) AS n_removed, CASE WHEN r.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM rows_ r LEFT JOIN kept k USING (doc_id)
"""
