"""Line, substring, suffix and near-duplicate operators against brute force, on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fernhill.llm import near_duplicates as nd, suffix_dedup as sd
from fernhill.llm._induced import suffix_order
from fernhill.llm.line_dedup import drop_repeated_lines
from fernhill.llm.substring_dedup import drop_repeated_windows
from fernhill.llm.suffix_dedup import drop_earlier_strings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=0, n=40):
    """Copies, near copies, shared passages and lines, very long words, nulls and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, line = text(60), "  A common Line of More than Twenty  "
    out = []
    for i in range(n):
        t = text(r.randint(1, 120))
        kind = i % 8
        if kind == 1:
            t = out[r.randrange(len(out))][1] or ""
        elif kind == 2 and out:
            w = (out[0][1] or "x").split(" ")
            w[r.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = t + " " + passage + " " + text(5)
        elif kind == 4:
            t = t + "\n" + (line.upper() if r.random() < 0.5 else line) + "\n\n" + text(3)
        elif kind == 5:
            t = "ab" * r.randint(10, 90) + "\t\n" + "x" * 400
        elif kind == 6:
            t = [None, "", " \n\t ", "one", "\n"][r.randrange(5)]
        out.append((i * 3 + 1, t))
    return out


def test_lines(docs):
    rows = corpus(1) + [(None, "A common Line of More than Twenty"), (4, "again A COMMON line of more than twenty"), (4, "again A COMMON line of more than twenty")]
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(LOWER)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    frame = docs([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    out = drop_repeated_lines(frame)
    assert out.columns == ["doc_id", "text", "n_lines", "key", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert drop_repeated_lines(docs([])).count() == 0


def test_words(docs):
    rows = corpus(2) + [(None, "null id " * 20), (1, None)]
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    out = drop_repeated_windows(docs(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == want
    for r in out:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed
    assert drop_repeated_windows(docs([])).count() == 0


@pytest.mark.parametrize(("seed", "hot"), [(3, 512), (4, 512), (3, 1)])
def test_bytes(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = corpus(seed) + [(None, "before all others " * 9), (500, "before all others " * 9), (1, (corpus(seed)[0][1] or "") + "y")]
    rank = lambda i: -1 if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], 10**9), rank(i))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = b"\1" * 50
        want[i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)] += 1
    out = drop_earlier_strings(docs(rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out) == want
    assert drop_earlier_strings(docs([])).count() == 0


def test_induced_order_with_and_without_disk():
    r = random.Random(5)
    for _ in range(80):
        k, depth = r.choice([1, 2, 4]), r.choice([3, 8, 50])
        text = [c for _ in range(r.randint(1, 9)) for c in [*(r.randint(1, k) for _ in range(r.randint(1, 30))), 0]]
        order, lcp = suffix_order(np.array(text, np.int16), k + 1, depth, limit=r.choice([40, 10**8]))
        assert sorted(order.tolist()) == list(range(len(text)))
        head = lambda i: text[i : i + depth][: (text[i : i + depth] + [0]).index(0) + 1]  # noqa: B023, E731
        for a, b, n in zip(order[:-1], order[1:], lcp[1:]):
            x, y = head(a), head(b)
            assert x <= y
            same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert 0 in x[: max(same, int(n))] or same == n


def near_brute(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("members", [128, 3])
def test_near(docs, monkeypatch, members):
    monkeypatch.setattr(nd, "MEMBERS", members)
    rows = corpus(6, 64)
    base = " ".join(f"w{k}" for k in range(300)).split()
    for j in range(12):  # a chain of near copies
        base[j * 9 % 300] = f"v{j}"
        rows.append((1000 - j, " ".join(base)))
    got = nd.near_duplicates(docs(rows), size=4, num=85, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows, 4, 85, 100)


def test_near_odd_rows(docs):
    got = nd.near_duplicates(docs([(None, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (5, "a b c d e f"), (7, None)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 2, "3"), ("5", 2, "3"), ("5", 2, "3"), ("7", 0, "7"), ("None", 2, "None")]
    assert nd.near_duplicates(docs([])).count() == 0


def test_rare_prefixes_meet_all_links():
    """Any two linked sets have a key in common, whatever else is in the corpus."""
    r = random.Random(0)
    for trial in range(400):
        num, den = [(85, 100), (4, 5)][trial % 2]
        base = list(range(r.randint(1, 60)))
        sets = []
        for _ in range(12):  # copies with a few changes, and sets that share a part
            s = set(base if r.random() < 0.7 else base[: len(base) // 2] + [r.randrange(10**6) for _ in base])
            for _ in range(r.randint(0, 6)):
                s.discard(r.choice(base))
                s.add(r.randrange(100, 140))
            sets.append(s)
        held = Counter(x for s in sets for x in s)
        order = {x: r.random() for x in held}
        keys = []
        for s in sets:
            shared = sorted((x for x in s if held[x] > 1), key=order.get)
            keys.append(set(shared[: int(nd.rare_prefix(np.array([len(s)]), np.array([len(shared)]), num, den)[0])]))
        for i in range(12):
            for j in range(i):
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    assert keys[i] & keys[j]


def test_near_across_bands(docs):
    """Pairs of a text and the same text with words added, whose sizes lie in adjacent bands."""
    for num, den in ((85, 100), (4, 5)):
        step = 1.01 * np.log(den / num)
        rows = []
        for n in range(4, 130):
            more = min(n * (den - num) // num, 1 + n % 9)
            if more and int(np.log(n) / step) != int(np.log(n + more) / step):
                words = [f"d{n}w{k}" for k in range(n + more + 3)]
                rows += [(2 * n, " ".join(words[: n + 3])), (2 * n + 1, " ".join(words))]
        assert len(rows) > 40
        got = nd.near_duplicates(docs(rows), size=4, num=num, den=den).collect()
        want = near_brute(rows, 4, num, den)
        assert all(i - i % 2 == least for i, (_, least) in want.items())
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def morse(n, a="a", b="b"):
    """The first 2 ** n letters of the sequence whose polynomial hashes to any odd base collide."""
    x = a
    for _ in range(n):
        x += x.translate(str.maketrans(a + b, b + a))
    return x


def test_regular_texts_do_not_collide(docs):
    one, two = morse(10), morse(10, "b", "a")
    words = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([one, *words])), (2, " ".join([two, *words]))]
    assert all(r.n_removed == 0 for r in drop_repeated_windows(docs(rows)).collect())
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(docs([(1, one), (2, two), (3, f"{one} x"), (4, f"{two} x")])).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    long = [morse(11).replace("a", "p ").replace("b", "q "), morse(11).replace("a", "q ").replace("b", "p ")]
    assert len({tuple(nd.shingle_sets([t.encode()], 2048)[1].tolist()) for t in long}) == 2


def test_very_long_texts(docs):
    r = random.Random(8)
    body = " ".join(f"w{r.randrange(4000)}" for _ in range(60_000))
    rows = [(1, body), (2, body[:200_000] + " other"), (3, "x" * 300_000), (4, "y" + "x" * 300_000), (5, "short")]
    got = {r.doc_id: r.n_removed for r in drop_earlier_strings(docs(rows)).collect()}
    assert got.pop(2) >= 200_000 and got == {1: 0, 3: 0, 4: 300_000, 5: 0}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in drop_repeated_windows(docs(rows)).collect()}
    n = len(body[:200_000].split()) - (not body[200_000].isspace())
    assert words[1][0] == 60_000 and words[1][1] >= n - 1 and words[3] == (1, 0)
    near = {r.doc_id: r.component_id for r in nd.near_duplicates(docs([*rows, (6, body.replace("w7 ", "w8 "))])).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}
    lines = {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs([(i, t + "\n" + t) for i, t in rows] + [(6, body), (7, body)])).collect()}
    assert lines == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}


def test_near_copies_of_one_text_in_many_blocks(docs, monkeypatch):
    """Copies with few and many changes and of several sizes: some link, some only look alike."""
    monkeypatch.setattr(nd, "MEMBERS", 3)
    r = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(120 + r.randrange(-9, 10))]
        for k in r.sample(range(100), r.choice([0, 1, 2, 4, 6])):
            words[k] = r.choice([f"own{i}x{k}", f"some{k}"])
        rows.append((i, " ".join(words)))
    got = nd.near_duplicates(docs(rows), size=4, num=85, den=100).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == near_brute(rows, 4, 85, 100)
