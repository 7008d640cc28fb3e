import random
import re

from skarn.llm import decontam

ITEM = "John and Mary went to the large market on Monday. Then John bought 5 pears for Mary at the old stall."
FILL = "some quite ordinary words stand here"


def found(spark, docs, items):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}


def test_names_in_any_space_case_and_place(spark):
    other = ITEM.replace("John", "Ahmed").replace("Mary", "Ida").replace("5", "17")
    docs = {
        1: f"{FILL} {ITEM.replace(' ', '  ' + chr(10))} {FILL}",
        2: f"{FILL} {ITEM.upper()} {FILL}",
        3: f"{FILL} {ITEM.lower()} {FILL}",
        4: f"{FILL} {other} {FILL}",
        5: other.replace(" ", "\t"),
        6: other.replace("Ahmed", "AHMED"),
        7: f"{FILL} {other.replace('for Ida', 'for Una')} {FILL}",
        8: f"{FILL} {FILL}",
    }
    assert found(spark, docs, {1: ITEM}) == {(d, 1) for d in range(1, 7)}
    start = {1: "Tom has nine grey geese behind his barn."}
    assert found(spark, {1: "Is it so. Ann has nine grey geese behind his barn."}, start) == {(1, 1)}


def test_exact_copies_of_placeholders(spark):
    items = {1: "Convert 5 km to 3 miles", 2: "3 4 5 6 7 8 9 10", 3: "12 kg 7 cm 9 ml 4 kg 88 mm 3 km add to a sum that you know well by now"}
    docs = {
        1: f"{FILL} convert 5 km\tto 3 MILES {FILL}",
        2: "1 2 3 4 5 6 7 8 9 10",
        3: "1 3 4 5 6 7 8 9 11",
        4: "Convert 6 km to 3 miles",
        5: "99 kg 17 cm 91 ml 14 kg 8 mm 33 km add to a sum that you know well by now",
        6: "12 kg 7 cm 9 ml 4 kg 88 mm 3 km add to a line of other words here",
    }
    assert found(spark, docs, items) == {(1, 1), (2, 2), (5, 3), (6, 3)}


def typed(words):
    out = []
    for w in words:
        first = re.search(r"[^\W\d_]", w)
        if re.search("[0-9]", w):
            out.append("#")
        elif out and out[-1] == "#" and w.lower().rstrip(".,;:!?)") in decontam.UNITS:
            out.append("%")
        else:
            out.append("@" if first and first[0].isupper() else w.lower())
    return out


def by_search(doc, item):
    """Whether the item is leaked, by comparing every place of the item with every place of the document."""
    d, m = doc.split(), item.split()
    if not m:
        return False
    td, tm, low_d, low_m = typed(d), typed(m), [w.lower() for w in d], [w.lower() for w in m]
    span, bare = min(8, len(m)), lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
    heavy = lambda at, n: 2 * sum(x in "#%@" for x in tm[at : at + n]) > n
    places = range(len(m) - span + 1)
    covered = {p for p in places if any(low_m[p : p + span] == low_d[q : q + span] for q in range(len(d)))}
    by_shift = {}
    for p in places:
        at, n = p, span
        if heavy(at, n):
            at, n = min(p, len(m) - 16), 16
            if at < 0 or heavy(at, n):
                continue
        for q in range(len(d) - n + 1):
            if tm[at : at + n] == td[q : q + n] and set(tm[at : at + n]) & set("#%@"):
                by_shift.setdefault(q - at, []).append((p, at, n))
    for shift, hits in by_shift.items():
        at = sorted({i for _, a, n in hits for i in range(a, a + n) if tm[i] in "#%@"})
        pairs = {(bare(m[i]), bare(d[i + shift]), tm[i]) for i in at}
        one_way = len({(a, b) for a, b, _ in pairs}) == len({a for a, _, _ in pairs})
        named = {(a, b) for a, b, k in pairs if k == "@"}
        if one_way and len(named) == len({b for _, b in named}):
            covered |= {p for p, _, _ in hits}
    return len(covered) >= 0.5 * len(places)


def test_random_slotted_items_against_search(spark):
    rng = random.Random(12)
    plain, names, units = [f"w{c}{e}x" for c in "abcdef" for e in "ghijk"], [f"N{c}o" for c in "abcdefgh"], ["km", "kg", "hours,"]

    def passage(n):
        out = []
        while len(out) < n:
            out += rng.choice([[rng.choice(plain)]] * 5 + [[rng.choice(names)], [str(rng.randint(2, 9)), rng.choice(units)], [f"({rng.randint(2, 99)}"]])
        return out[:n]

    items = {i: passage(rng.choice([3, 8, 11, 20, 35])) for i in range(25)}
    docs, wanted = {}, set()
    for d in range(120):
        words = passage(30)
        m = items[d % 25]
        if d % 4:
            change = {n: rng.choice(names) if rng.random() < 0.2 else n for n in names} if d % 4 > 1 else dict(zip(names, rng.sample(names, 8), strict=True))
            copy = [change.get(w, w if w.isalpha() or rng.random() < 0.7 else "7") for w in m]
            if d % 3 == 0 and len(copy) > 10:
                copy[5:6] = []
            words[9:9] = [w.upper() for w in copy] if d % 10 == 5 else copy
        docs[d] = rng.choice([" ", "\n", " \t "]).join(words)
        wanted |= {(d, i) for i, m in items.items() if by_search(docs[d], " ".join(m))}
    assert len(wanted) > 40
    assert found(spark, docs, {i: " ".join(m) for i, m in items.items()}) == wanted
