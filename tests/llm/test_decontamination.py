import random
import re
from collections import Counter

import numpy as np

from parlance.llm import decontamination


def counts(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, items, threshold=0.8):
    """(doc, item) -> best weighted similarity over all windows of the item's size."""
    out = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    for d, t in docs:
        w = split(t)
        for i, it in items:
            v = split(it)
            if not v or len(w) < len(v) or (len(v) < 5 and len(v) != len(w)):
                continue
            own = counts(v)
            best = 0.0
            for a in range(len(w) - len(v) + 1):
                here = counts(w[a : a + len(v)])
                both = sum((own & here).values())
                best = max(best, both / (own.total() + here.total() - both))
            if best >= threshold:
                out[d, i] = best
    return out


def made_up():
    rnd = random.Random(8)
    vocab = ["v%d" % i for i in range(200)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([3, 12, 20, 20, 35, 50])))) for i in range(40)] + [(100, ""), (101, None), (102, "same same same same same same same same")]
    docs = []
    for d in range(150):
        body = text(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            passage = (items[rnd.randrange(40)][1]).split(" ")
            for _ in range(rnd.randint(0, 2)):
                passage[rnd.randrange(len(passage))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                passage.insert(len(passage) // 2, "extra")
            at = rnd.randint(0, len(body))
            body = body[:at] + [w.upper() if rnd.random() < 0.5 else w for w in passage] + body[at:]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (903, "same " * 30)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = made_up()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 25
    for block in (20_000, 7):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(d, b, block_items=block).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_index_gives_every_fingerprint_within_the_radius():
    rnd = np.random.default_rng(3)
    index = decontamination.Index([(i, " ".join(map(str, rnd.integers(0, 99, 20 + i % 3)))) for i in range(30)], 20, 0.8)
    for i in range(30):
        for _ in range(20):
            bits = np.unpackbits(index.prints[i])
            flip = rnd.choice(64, rnd.integers(0, 21), replace=False)
            bits[flip] ^= 1
            near = np.packbits(bits).view(np.uint16)
            assert any(i in index.near(20 + i % 3, b, int(near[b])) for b in range(4))


def test_radius_keeps_pairs_at_the_threshold():
    """Windows whose similarity is just above the threshold, with repeated shingles too: nearly all lie within the radius."""
    rnd = np.random.default_rng(4)
    inside = total = 0
    for n in (20, 60, 200):
        for repeat in (1, 9):
            for _ in range(150):
                own = rnd.integers(0, 2**63, n, dtype=np.uint64)
                other = own.copy()
                change = n // 9
                other[rnd.choice(n, change, replace=False)] = rnd.integers(0, 2**63, change, dtype=np.uint64)
                own, other = (np.concatenate([x, np.repeat(x[:1], repeat - 1)]) for x in (own, other))
                both = sum((Counter(own.tolist()) & Counter(other.tolist())).values())
                if both / (2 * len(own) - both) < 0.8:
                    continue
                a, b = (decontamination.fingerprint(decontamination.signs(decontamination.occurrences(x)).sum(0, dtype=np.int32)) for x in (own, other))
                total += 1
                inside += int(np.bitwise_count(a ^ b).sum()) <= 20
    assert total > 500 and inside >= 0.995 * total


def test_null_large_and_repeated_ids_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(2**60 + 1, f"x {item} y", 1), (None, f"{item} z", 2), (-1, item, 3), (-1, item, 4), (5, "w " * 1_300_000 + item, 5), (6, None, 6)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(None, item, 1), (2**60 + 3, item, 2), (2**60 + 3, item, 2)], "item_id bigint, text string, doc_id int")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontamination.contaminated(d, b).collect())
    assert got == sorted((str(i), str(j)) for i in (2**60 + 1, None, -1, -1, 5) for j in (None, 2**60 + 3))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    assert decontamination.contaminated(d, b).count() == decontamination.contaminated(one, b).count() == 0
