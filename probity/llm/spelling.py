"""Groups of spelling variants: words of a corpus that differ by one code point.

A word's letters are a binary vector with a coordinate for each (letter, how often
it came before in the word). One inserted or deleted letter changes one coordinate,
a replaced one at most two, so near words lie within a Hamming distance of two.
PartEnum: coordinates are dealt into PARTS parts; two such vectors agree on all of
some PARTS - 2 of them, so a signature is made for every choice of two parts to leave
out, of the coordinates in all others. Words of equal signatures meet in an equi-join
and are verified by their edit distance, and no near pair is lost.

Counts come first: occurrences are summed up where they are read. What follows works
on distinct words only.

Edge cases. Null and empty texts have no words. A null doc_id is written as nothing
where occurrences are hashed. Repeated rows count each time. An empty table gives no
row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.shared import lower_ascii, materialize

#: A run of these is a word.
LETTERS = r"[A-Za-z\u00C0-\u00FF]"
#: Parts of the coordinates; a signature leaves out two of them. More parts give more
#: signatures and fewer words that share one by chance.
PARTS, DISTANCE = 5, 2
#: Code points at a word's beginning or end that a signature also holds: one edit in a
#: word of twice as many leaves either its beginning or its end as it was.
AFFIX = 3


def lowered(run: Column) -> Column:
    """A-Z alone lower-cased; lower() is the quick way for runs of these alone."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(lower_ascii(run))


def vocabulary(docs: DataFrame, every: int = 199, least_length: int = 2 * AFFIX, least_count: int = 5) -> DataFrame:
    """(word, n): distinct words that occur at least least_count times. In about one of
    `every` occurrences, chosen by the hash of doc_id and word, a code point chosen by it
    is left out; words of at least least_length code points then count."""
    if least_length < 2 * AFFIX:
        raise ValueError(f"words of less than {2 * AFFIX} code points may change at both ends at once")
    runs = F.regexp_extract_all("text", F.lit(LETTERS + f"{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))
    h, length = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    slips, at = h % every == 0, (h % length).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    words = each.where((length > least_length) | ~slips).select(F.when(slips, slipped).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def signatures(word: Column) -> Column:
    """The PartEnum signatures of a word: a long for each choice of parts left out and each
    end of the word. A part is the combined hash of its coordinates, so the order of letters
    plays no role."""
    # equal letters stand together when sorted: a letter's coordinate is its distance from the first of its kind
    coordinates = lambda letters: F.transform(letters, lambda x, i: F.xxhash64(x, (i + 1 - F.array_position(letters, x)).cast("int")))
    part = lambda h: F.pmod(F.shiftrightunsigned(h, 7), F.lit(PARTS))
    combined = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    parts = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: combined(F.filter(hashes, lambda h: part(h) == k)))
    ends = (F.substring(word, 1, AFFIX), F.substring(word, -AFFIX, AFFIX))
    choices = list(combinations(range(PARTS), DISTANCE))
    keys = lambda p: F.array(*[F.xxhash64(F.lit(i), F.lit(e), end, *[p[k] for k in range(PARTS) if k not in left]) for e, end in enumerate(ends) for i, left in enumerate(choices)])
    return _let(F.array_sort(F.split(word, "")), lambda letters: _let(coordinates(letters), lambda hashes: _let(parts(hashes), keys)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: words (word, n) that differ by exactly one inserted,
    deleted or replaced code point."""
    signed = words.select("word", "n", F.explode(signatures(F.col("word"))).alias("signature"))
    left = signed.select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"))
    size = F.char_length("a") - F.char_length("b")
    near = (F.col("a") < F.col("b")) & size.between(-1, 1) & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1)
    return left.join(right.hint("merge"), "signature").where(near).select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n). form is the most frequent
    near word (the smallest of equally frequent ones) if it comes at least `ratio` times
    as often; root follows forms to the last."""
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    formed = F.col("near_n") >= ratio * F.col("n")
    joined = materialize(joined.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    links = joined.where("form is not null").select("word", F.col("form").alias("root"))
    # a form comes `ratio` times as often as its word, so chains are at most log(n) long; each round doubles what is followed
    most, reach, longest = words.agg(F.max("n")).first()[0] or 1, 1, 1
    while ratio**longest <= most:
        longest += 1
    while reach < longest:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    return joined.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs (doc_id, text)."""
    return variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, by distances within words of equal beginnings or ends."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    latin = "".join(map(chr, range(0xC0, 0x100)))
    # DuckDB's levenshtein counts bytes: each letter beyond ASCII gets an ASCII character that no word holds
    single = "".join(c for c in map(chr, range(33, 127)) if c not in lower + "'")[: len(latin)]
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, '{upper}', '{lower}') AS run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM lowered, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
coded AS (SELECT word, n, translate(word, '{latin}', '{single}') AS k FROM words),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM coded a JOIN coded b ON left(a.word, 3) = left(b.word, 3) AND abs(length(a.k) - length(b.k)) <= 1 AND a.word <> b.word AND levenshtein(a.k, b.k) = 1
  UNION
  SELECT a.word, b.word, b.n FROM coded a JOIN coded b ON right(a.word, 3) = right(b.word, 3) AND abs(length(a.k) - length(b.k)) <= 1 AND a.word <> b.word AND levenshtein(a.k, b.k) = 1),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY 1),
first AS (SELECT word, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
