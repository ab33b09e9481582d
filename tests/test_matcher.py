"""The trie must match exactly what a flat longest-first alternation matches, in Python and in Spark."""

import random
import re

from pyspark.sql import functions as F

from sievelake.functions import vocab
from sievelake.functions.matcher import LEFT, RIGHT, all_terms, compile_terms, spans


def flat_of(terms):
    """A yardstick for the trie: every term spelled out, a longer one before its beginnings."""
    spelled = [re.escape(t) for t in sorted({t.lower() for t in terms}, key=len, reverse=True)]
    return re.compile(LEFT + "(?:" + "|".join(spelled) + ")" + RIGHT, re.IGNORECASE)


def _texts(terms, n, seed):
    rng = random.Random(seed)
    glue = [" ", ", ", ".", "/", "-", "", "x", "+", "#", "(", ")", "\n", ". "]
    return ["".join(rng.choice(terms + ["zz", "9", "C", "Java."]) + rng.choice(glue) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_trie_equals_alternation_for_all_vocabularies():
    for terms in (list(vocab.DEFAULT.alias_to_skill), list(vocab.DEFAULT.keyword_to_category), vocab.STRONG_TECH, vocab.ENTERPRISE, ["react", "react native", "c", "c++", "c#", ".net", "node", "node.js"]):
        trie, flat = re.compile(compile_terms(terms)), flat_of(terms)
        for t in _texts(terms, 2000, 1):
            assert trie.findall(t) == flat.findall(t), t


def test_spark_equals_python(spark):
    terms = list(vocab.DEFAULT.alias_to_skill)
    texts = _texts(terms, 800, 2)
    p = compile_terms(terms)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", all_terms(F.col("t"), p).alias("m"), spans(F.col("t"), p).alias("s")).collect()}
    flat = flat_of(terms)
    for i, t in enumerate(texts):
        found = list(flat.finditer(t))
        assert got[i].m == [m[0].lower() for m in found]
        assert [(s.start, s.match) for s in got[i].s] == [(m.start(), m[0]) for m in found]


def test_empty_vocabulary_matches_nothing():
    assert not re.search(compile_terms([]), "anything")
