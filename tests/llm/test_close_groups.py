"""Near-duplicates in large groups that are close to each other, without being linked."""

import random

from riskloom.llm import neardup
from tests.llm.test_operators import _components


def _family(base, count, name, edits=1, seed=0):
    """`count` texts, each with a few words of its own at places of its own."""
    draw = random.Random(seed)
    out = []
    for i in range(count):
        words = list(base)
        for j, at in enumerate(draw.sample(range(len(base)), edits)):
            words[at] = f"{name}{i}x{j}"
        out.append(" ".join(words))
    return out


def _variant(base, start, words, name):
    """The base with one passage replaced."""
    return base[:start] + [f"{name}{i}" for i in range(words)] + base[start + words:]


BASE = [f"w{i}" for i in range(200)]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def _joined_rows(spark, texts, monkeypatch):
    """Rows of the join of members on their keys, and the classes."""
    seen = []
    inner = neardup.Pairs.member_prefixes

    def counted(self, stars, found):
        left, right = inner(self, stars, found)
        seen.append((left.count(), right.count(), left.join(right, "key").count()))
        return left, right

    with monkeypatch.context() as patch:
        patch.setattr(neardup.Pairs, "member_prefixes", counted)
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(_frame(spark, texts)).collect()}
    return seen[0], out


def test_close_groups_are_not_paired(spark, monkeypatch):
    # Three variants of one text, about 0.6 of each other, every one with many near copies.
    def texts(m):
        return [t for k, at in enumerate((0, 60, 120)) for t in _family(_variant(BASE, at, 24, f"v{k}-"), m, f"e{k}-", seed=k)]

    for m in (40, 160):
        (_, right_n, met), out = _joined_rows(spark, texts(m), monkeypatch)
        assert right_n + met <= m
        assert {c for _, c in out.values()} == {0, m, 2 * m}


def test_groups_linked_through_members_only(spark, monkeypatch):
    # Variants near the bound: some members of two groups are links, most are not; bridges stand between others.
    draw = random.Random(5)
    texts = []
    for k, (at, n) in enumerate(((0, 8), (40, 9), (80, 10), (120, 14), (150, 24))):
        variant = _variant(BASE, at, n, f"v{k}-")
        texts += _family(variant, 12, f"e{k}-", edits=k % 3 + 1, seed=k)
        texts += [" ".join(variant[:draw.randint(150, 190)]) for _ in range(4)]
    texts += [" ".join(_variant(_variant(BASE, 120, 14, "v3-"), 150, n, "v4-")) for n in (6, 12, 18, 24)]
    draw.shuffle(texts)
    _, out = _joined_rows(spark, texts, monkeypatch)
    assert out == _components(dict(enumerate(texts)))
