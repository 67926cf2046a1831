import hashlib
import re

from corpusloom.llm.decontaminate import decontamination_report, drop_contaminated, remove_spans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, ""), (5, "short item"), (None, "null id item words here"), (10, "a b a b a b a b a b a b a b")]
DOCS = [
    (1, "x One, two three four five six seven eight nine ten! y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "a SHORT item short-item"), (5, "a SHORT item short-item"),
    (None, "well null id item words here ok"), (6, "b a b a b a b a b a b a b a b a b"), (7, "z " * 50_000 + "short item"), (8, "clean"),
]


def test_report_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination_report(docs, items).drop("text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(DOCS, ITEMS)
    assert decontamination_report(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in decontamination_report(docs, items.limit(0)).collect())


def test_dropping_and_removing(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, _sha int, _at int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 8]
    cleaned = {r["doc_id"]: r["text"] for r in remove_spans(docs.where("doc_id IN (1, 5, 8)"), items).collect()}
    assert cleaned[8] == "clean" and words(cleaned[1]) == ["x", "y"] and words(cleaned[5]) == ["a"] and cleaned[1].endswith("! y")


def test_removed_spans_against_brute_force(spark):
    rows = DOCS + [(20, "short item one short item"), (21, "One two three four five six seven eight nine ten eleven twelve. b? one two THREE four five six seven eight nine ten"), (22, " - short: item - ")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    wins = {tuple(w[i : i + 10]) for _, t in ITEMS if (w := words(t)) for i in range(max(len(w) - 9, 1))}

    def without(text):
        if text is None:
            return None
        found = [*re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
        w = words(text)
        hit = {k for n in {len(x) for x in wins} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins for k in range(i, i + n)}
        out, last = [], 0
        for k, m in enumerate(found):
            out += [text[last : m.start()], "" if k in hit else m[0]]
            last = m.end()
        return "".join(out) + text[last:]

    got = sorted(((r["doc_id"], r["text"]) for r in remove_spans(docs, items).collect()), key=str)
    assert got == sorted(((i, without(t)) for i, t in rows), key=str)
