"""Full-text expressions against SQLite's own full-text engine, by scan and by index."""

from __future__ import annotations

import random
import sqlite3

import pytest
from plan_metrics import rows_read

from shoal.plans import fulltext
from shoal.plans.fulltext import TextIndex, parsed, text_matches
from shoal.shared import fresh_path

LINES = "id long, image_id long, text string"
KNOWN = [(1, 1, "don't stop me"), (2, 2, "foo-bar baz café"), (3, 3, "stop other"), (4, 4, "one two three"), (5, 5, "two one"), (6, 5, "other ÀÉ thing"), (7, 6, "a_b c"), (8, 7, None), (9, 8, ""), (10, 9, "!? -")]
ASKED = ['"foo-bar"', '"don\'t stop"', "stop AND me", "(stop OR other) NOT me", '"foo ba"*', "cafe", "one NOT two three", "one OR two three", "a_b", '"!!" one', '"!!" AND one', 'one NOT "!!"', '"!!"', "one + two", "^one", '"one two" *', "ae",
         "one and two", "one   two*", "one two OR three AND stop NOT me", "one + tw*", "o* + tw*", "^ one + two", "(one)", "((stop) OR (two NOT ^one))", '"say ""x"""', "^ÂE OR ^other + a*"]
WRONG = ["NOT one", "(one OR two) three", "one AND NOT two", "foo-bar", "", "()", "one OR", '"a b', "*", "two + ^one", "one)", "text : one", "NEAR(one two)", "one (two)"]


def engine(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(image_id UNINDEXED, text)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full text")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(r[1], r[2]) for r in rows])
    return lambda q: sorted(r[0] for r in con.execute("SELECT DISTINCT image_id FROM f WHERE text MATCH ?", (q,)))


def ids(df):
    return sorted(r.image_id for r in df.collect())


def expressions(n, seed, vocab):
    rng = random.Random(seed)

    def phrase():
        kind = rng.random()
        word = rng.choice(vocab)
        if kind < 0.45:
            return word
        if kind < 0.6:
            return word[: rng.randint(1, len(word))] + "*"
        if kind < 0.75:
            return '"' + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 3))) + '"' + rng.choice(["", "*"])
        if kind < 0.85:
            return f"{word} + {rng.choice(vocab)}"
        return rng.choice(["^", "^ "]) + word if kind < 0.95 else '"?!"'

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(phrase() for _ in range(rng.choice([1, 1, 2])))
        a, b = tree(depth - 1), tree(depth - 1)
        wrap = lambda x: f"({x})" if rng.random() < 0.5 else x
        return f"{wrap(a)} {rng.choice(['AND', 'OR', 'NOT'])} {wrap(b)}"

    return [tree(rng.randint(0, 3)) for _ in range(n)]


@pytest.fixture(scope="module")
def known(spark):
    lines = spark.createDataFrame(KNOWN, LINES)
    return lines, TextIndex.create(lines, fresh_path(spark, "index"))


@pytest.mark.parametrize("expression", ASKED)
def test_known_expressions(known, expression):
    want = engine(KNOWN)(expression)
    assert ids(text_matches(known[0], expression)) == want
    assert ids(known[1].search(expression)) == want


@pytest.mark.parametrize("expression", WRONG)
def test_what_is_no_expression(spark, expression):
    with pytest.raises(ValueError):
        parsed(spark, expression)


def test_random_expressions(spark):
    rng = random.Random(5)
    vocab = ["sun", "sunny", "sûn", "moon", "mo", "élan", "elan", "star", "stars", "7up", "a"]
    rows = [(k, k // 2, rng.choice(["", "", "¡", "- "]) + rng.choice([" ", ", ", "_"]).join(rng.choice(vocab).upper() if rng.random() < 0.2 else rng.choice(vocab) for _ in range(rng.randint(0, 6)))) for k in range(120)]
    lines = spark.createDataFrame(rows, LINES)
    index, judge = TextIndex.create(lines, fresh_path(spark, "index")), engine(rows)
    hits = 0
    for k, q in enumerate(expressions(40, 1, vocab)):
        want = judge(q)
        hits += 0 < len(want) < 60
        assert ids(text_matches(lines, q)) == want, q
        if k < 15:
            assert ids(index.search(q)) == want, q
    assert hits > 15


def test_appends_and_removals(spark):
    frame = lambda rows: spark.createDataFrame(rows, LINES)
    index = TextIndex.create(frame([(1, 1, "red fox"), (2, 2, "red hen"), (2, 2, "second row of a line")]), fresh_path(spark, "index"))
    assert ids(index.search("red")) == [1, 2] and ids(index.search("second NOT red")) == [2]
    index.append(frame([(3, 3, "red dog"), (None, 9, "red nobody")]))
    assert ids(index.search("red")) == [1, 2, 3]
    index.remove(frame([(1, None, None), (3, None, None)]).select("id"))
    assert ids(index.search("red")) == [2] and ids(index.search("re*")) == [2]
    index.append(frame([(3, 3, "blue dog"), (4, 1, "red again")]))
    assert ids(index.search("red")) == [1, 2] and ids(index.search("dog")) == [3]
    assert ids(TextIndex(spark, index.path).search("red OR blue")) == [1, 2, 3]


def test_empty_index(spark):
    index = TextIndex.create(spark.createDataFrame([], LINES), fresh_path(spark, "index"))
    assert ids(index.search("a")) == ids(index.search("a*")) == ids(index.search('"?"')) == []


def test_rows_read_grow_with_hits_not_with_lines(spark):
    """Ten times the lines that don't match: a search reads the same rows; the scan reads them all."""
    read = []
    for n in (500, 5000):
        rows = spark.range(n).selectExpr("id", "id AS image_id", "CASE WHEN id < 20 THEN concat('rare find ', id) ELSE concat('filler', id % 97, ' word', id % 89, ' and ', id) END AS text")
        index = TextIndex.create(rows, fresh_path(spark, "index"), bucket_rows=64)
        found = index.search('rare + find NOT "find 7"')
        read.append(rows_read(found))
        assert len(ids(found)) == 19
    assert read[1] <= read[0] + 200 and read[1] < 2000
