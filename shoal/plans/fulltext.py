"""Full-text search over lines: an expression grammar, a scan, and a stored positional index.

The index is a Parquet table of occurrences ``(term, line, image, mark, pos)``: a folder for each bucket of term
hashes, sorted by term, line and place, with delta-encoded numbers, and a sorted dictionary of terms
beside it. A search reads the folders of its own terms only, and of those the row groups whose terms
it asks for; a prefix is looked up in the dictionary first. All of an expression is one scan and one
grouping by line, whatever operators it has. Appends and removals are generations of their own that a log
makes visible, so neither rewrites what is there.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.generations import Generations
from ..sources.views import query

#: Occurrences that a bucket is made for, and the fewest and most buckets of an index.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 16, 4096
#: Occurrences of a page: what a search reads of a bucket at least.
PAGE = 1 << 12
POSTINGS = "term string, line long, image long, mark long, pos int, bucket int"


def _letters() -> tuple[str, str]:
    """Letters with marks and their base letters, by Unicode's own decomposition."""
    marked = {}
    for code in range(0xC0, 0x3000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and len(parts[0]) == 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            marked[chr(code)] = parts[0]
    return "".join(marked), "".join(marked.values())


_MARKED, _BASE = _letters()


def tokens(text: Column) -> Column:
    """Words of a text in order: runs of letters and digits, lower-cased, without diacritics. A null text has none."""
    folded = F.regexp_replace(F.translate(F.lower(text), _MARKED, _BASE), r"\p{Mn}", "")
    return F.filter(F.split(F.coalesce(folded, F.lit("")), r"[^\p{L}\p{N}\p{Co}]+", -1), lambda w: w != "")


@dataclass(frozen=True)
class Phrase:
    """Consecutive words, each whole or as a prefix; ``first``: at the line's beginning."""

    words: tuple[tuple[str, bool], ...]
    first: bool = False


@dataclass(frozen=True)
class Both:
    left: Phrase | Both | Either | Without | None
    right: Phrase | Both | Either | Without | None


@dataclass(frozen=True)
class Either(Both):
    pass


@dataclass(frozen=True)
class Without(Both):
    pass


_SIGN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()+*^])|([0-9A-Za-z_\x1a\x80-\U0010ffff]+))')


class _Reader:
    """Recursive descent over an expression's signs; strings are left for the tokenizer."""

    def __init__(self, text: str):
        self.signs: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _SIGN.match(text, at)
            if not m:
                raise ValueError(f"not a full-text expression at {text[at:]!r}")
            quoted, sign, bare = m.groups()
            word = bare if bare is not None else (quoted or "").replace('""', '"')
            self.signs.append(("sign", sign) if sign else ("sign", bare) if bare in ("AND", "OR", "NOT") else ("string", word))
            at = m.end()
        self.at = 0
        self.strings: list[str] = []

    def _is(self, *signs: str) -> bool:
        return self.at < len(self.signs) and self.signs[self.at][0] == "sign" and self.signs[self.at][1] in signs

    def _take(self, *signs: str) -> bool:
        self.at += (found := self._is(*signs))
        return found

    def whole(self):
        tree = self.either()
        if self.at < len(self.signs):
            raise ValueError(f"unexpected {self.signs[self.at][1]!r} in a full-text expression")
        return tree

    def _level(self, sign: str, kind, below):
        tree = below()
        while self._take(sign):
            tree = (kind, tree, below())
        return tree

    def either(self):
        return self._level("OR", Either, lambda: self._level("AND", Both, lambda: self._level("NOT", Without, self.operand)))

    def operand(self):
        if self._take("("):
            tree = self.either()
            if not self._take(")"):
                raise ValueError("a bracket isn't closed in a full-text expression")
            return tree
        phrases = []
        while self._is("^") or (self.at < len(self.signs) and self.signs[self.at][0] == "string"):
            phrases.append(self.phrase())
        if not phrases:
            raise ValueError("a full-text expression lacks an operand")
        return ("all", phrases)

    def phrase(self):
        first, parts = self._take("^"), []
        while True:
            if self.at >= len(self.signs) or self.signs[self.at][0] != "string":
                raise ValueError("a full-text expression lacks a word")
            self.strings.append(self.signs[self.at][1])
            self.at += 1
            parts.append((len(self.strings) - 1, self._take("*")))
            if not self._take("+"):
                return ("phrase", first, parts)


def _built(node, words: list[list[str]]):
    """The tree with the tokenizer's words; an empty phrase is None, which matches nothing."""
    if node[0] == "phrase":
        found = [(w, prefix and k == len(words[s]) - 1) for s, prefix in node[2] for k, w in enumerate(words[s])]
        return Phrase(tuple(found), node[1]) if found else None
    if node[0] == "all":  # side by side, empty phrases don't count
        some = [x for x in (_built(p, words) for p in node[1]) if x is not None]
        return reduce(Both, some) if some else None
    return node[0](_built(node[1], words), _built(node[2], words))


def _back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _values(spark: SparkSession, columns: list[Column]) -> list:
    """Constants as Spark computes them; a plan without input, so no job runs."""
    return spark.sql("SELECT * FROM VALUES (0) AS one(x)").select(F.array(*columns)).first()[0]


def parsed(spark: SparkSession, expression: str):
    """The expression as a tree of ``Phrase``, ``Both``, ``Either`` and ``Without``.

    ``NOT`` binds before ``AND``, ``AND`` before ``OR``; words side by side must all be there and bind first.
    ``"several words"`` and ``one + two`` are phrases, ``word*`` a prefix, ``^word`` begins the line,
    brackets group. Strings go through the lines' own tokenizer. Anything else raises ValueError.
    """
    reader = _Reader(expression)
    tree = reader.whole()
    return _built(tree, _values(spark, [tokens(F.lit(s)) for s in reader.strings]))


def phrases(tree) -> list[Phrase]:
    """All phrases of a tree, each once."""
    if tree is None or isinstance(tree, Phrase):
        return [tree] if tree else []
    return list(dict.fromkeys(phrases(tree.left) + phrases(tree.right)))


def _holds(tree, of) -> Column:
    """The tree as a condition, given that of each phrase."""
    if tree is None:
        return F.lit(False)
    if isinstance(tree, Phrase):
        return of(tree)
    left, right = _holds(tree.left, of), _holds(tree.right, of)
    return left | right if isinstance(tree, Either) else left & ~right if isinstance(tree, Without) else left & right


def text_matches(lines: DataFrame, expression: str) -> DataFrame:
    """``image_id`` of images with a line that matches, by one scan of ``lines(image_id, text)``; see ``parsed`` for expressions."""
    tree = parsed(lines.sparkSession, expression)

    def holds(line: Column) -> Column:
        def of(p: Phrase) -> Column:
            if any(prefix for _, prefix in p.words[:-1]):
                body = " ".join(w + "[^ ]*" * prefix for w, prefix in p.words)
                return line.rlike(("^ " if p.first else " ") + body + ("" if p.words[-1][1] else " "))
            body = f" {' '.join(w for w, _ in p.words)}" + ("" if p.words[-1][1] else " ")
            return line.startswith(body) if p.first else line.contains(body)

        return _holds(tree, of)

    plain = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return lines.where(F.exists(F.array(plain), holds)).select("image_id").distinct()


class TextIndex(Generations):
    """A stored index under ``path``; one writer at a time.

    ``create`` fixes the number of buckets; ``append`` adds lines ``(id, image_id, text)``, ``remove`` takes
    lines out by id, ``search`` finds images. A line that comes again after its removal counts again; rows that
    share an id are told apart by their text's mark and are a line each. Null ids and null texts have no occurrences.
    """

    @classmethod
    def create(cls, lines: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> TextIndex:
        index = cls(lines.sparkSession, path)
        n = lines.agg(F.sum(F.size(tokens(F.col("text"))))).first()[0] or 0
        index._log(0, "buckets", min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (n // bucket_rows).bit_length())))
        index.append(lines)
        return index

    def append(self, lines: DataFrame) -> None:
        """Index further lines as a generation of their own: what is there stays untouched, and a failed append is never seen."""
        _, known, seq = self._state()
        found = lines.select(F.col("id").alias("line"), F.col("image_id").alias("image"), F.xxhash64("text").alias("mark"), F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
        found = found.where("line IS NOT NULL").withColumn("bucket", self._bucket(F.col("term"), known["buckets"]))
        order = ["bucket", "term", "line", "pos"]  # a term of very many lines is cut by line
        sorted_rows = found.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        delta = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#line": "false", "parquet.enable.dictionary#pos": "false", "parquet.enable.dictionary#image": "false"}
        sorted_rows.write.options(**delta).option("parquet.page.row.count.limit", PAGE).partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/seq={seq}")
        terms = self._read("postings", [seq], POSTINGS).groupBy("term").agg(F.count("*").alias("n"), F.first("bucket").alias("bucket"))
        terms.sort("term").write.mode("overwrite").parquet(f"{self.path}/terms/seq={seq}")
        self._log(seq, "lines")

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def occurrences(self, wanted: list[tuple[str, bool]]) -> DataFrame:
        """``(seq, line, image, mark, term, pos)`` of words and prefixes, from their buckets alone."""
        of_kind, known, _ = self._state()
        buckets, seqs = known["buckets"], of_kind["lines"]
        whole, begin = sorted({w for w, prefix in wanted if not prefix}), sorted({w for w, prefix in wanted if prefix})
        places = set(_values(self.spark, [self._bucket(F.lit(w), buckets) for w in whole])) if whole else set()
        term = F.col("term")
        if begin:
            starts = reduce(or_, [term.startswith(w) for w in begin])
            places |= {r[0] for r in self._read("terms", seqs, "term string, n long, bucket int").where(starts).select("bucket").distinct().collect()}  # a row a bucket at most
        asked = reduce(or_, ([term.isin(whole)] if whole else []) + ([starts] if begin else []))
        rows = self._read("postings", seqs, POSTINGS)
        return rows.where(F.col("bucket").isin(sorted(places)) & asked).select("seq", "line", "image", "mark", "term", "pos")

    def search(self, expression: str) -> DataFrame:
        """``image_id`` of images with a line that matches; the same as ``text_matches`` over the lines that are left."""
        tree = parsed(self.spark, expression)
        every = phrases(tree)
        words = list(dict.fromkeys(w for p in every for w in p.words))
        if not words:
            return self.spark.createDataFrame([], "image_id long")
        is_word = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
        placed = {w for p in every if len(p.words) > 1 or p.first for w in p.words}  # words whose places count
        each = [F.collect_list(F.when(is_word(*w), F.col("pos"))).alias(f"w{k}") if w in placed else F.max(is_word(*w)).alias(f"w{k}") for k, w in enumerate(words)]
        lines = self.occurrences(words).groupBy("seq", "line", "image", "mark").agg(*each)
        column = {w: F.col(f"w{k}") for k, w in enumerate(words)}

        def of(p: Phrase) -> Column:
            if len(p.words) == 1 and not p.first:
                return F.size(column[p.words[0]]) > 0 if p.words[0] in placed else column[p.words[0]]
            starts = reduce(F.array_intersect, [_back(column[w], k) for k, w in enumerate(p.words)])
            return F.array_contains(starts, 0) if p.first else F.size(starts) > 0

        found = lines.where(_holds(tree, of))
        found = self._live(found, "line")
        return found.select(F.col("image").alias("image_id")).distinct()


#: What the queries search for: every operator, with words of the lines in three languages.
EXPRESSION = 'the th* NOT of OR "in the" AND (time OR ^"i" OR people) OR café + "de" NOT xyz* OR ("don\'t" OR could) NOT (we "you")'


def _sql(table: str) -> str:
    """``EXPRESSION`` by hand, over lists ``w`` of words."""
    has = lambda w: f"list_contains(w, '{w}')"
    starts = lambda w: f"len(list_filter(w, lambda x: starts_with(x, '{w}'))) > 0"
    pair = lambda a, b: f"len(list_filter(list_zip(w, w[2:]), lambda p: p[1] = '{a}' AND p[2] = '{b}')) > 0"
    return rf"""
WITH l AS (SELECT image_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM {table})
SELECT DISTINCT image_id FROM l WHERE {has('the')} AND {starts('th')} AND NOT {has('of')} OR ({pair('in', 'the')} AND ({has('time')} OR w[1] = 'i' OR {has('people')}))
 OR ({pair('cafe', 'de')} AND NOT {starts('xyz')}) OR (({pair('don', 't')} OR {has('could')}) AND NOT ({has('we')} AND {has('you')}))"""


@query("fts_search", _sql("text_lines"), "text_lines")
def _fts_search(t):
    return text_matches(t.text_lines, EXPRESSION)


@query("fts_index", _sql("text_lines"), "text_lines")
def _fts_index(t):
    """The same through a stored index that grew by appends, with lines taken out and put in again."""
    from ..shared import fresh_path

    lines = t.text_lines
    early = F.col("id") % 2 == 0
    index = TextIndex.create(lines.where(early), fresh_path(t.spark, "text-index"))
    index.append(lines.where(~early))
    index.remove(lines.where("id % 3 = 0"))
    index.append(lines.where("id % 3 = 0"))
    return index.search(EXPRESSION)
