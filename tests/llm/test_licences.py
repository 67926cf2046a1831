import random
import re

from corpusloom.llm.licences import BASE, NOTICES, PERMISSIVE, evaluate, parse_expression, scan_licences, scan_text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_expressions():
    assert parse_expression("MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert parse_expression("(MIT OR GPL-3.0) AND BSD-3-Clause") == ["mit", "gpl-3.0", "or", "bsd-3-clause", "and"]
    for bad in ("", "OR MIT", "(MIT", "MIT OR", "MIT)"):
        assert parse_expression(bad) is None
    assert evaluate(parse_expression("GPL-3.0 OR MIT")) == ({"gpl-3.0", "mit"}, True)
    assert evaluate(parse_expression("GPL-3.0 AND MIT"))[1] is False


def test_tags_and_notices():
    got = scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nunder the Apache License, Version 2.0. All rights reserved.")
    assert got["labels"] == "apache-2.0,gpl-2.0-only,mit,reserved" and got["permissive"] is True
    assert got["base_labels"] == "reserved" and 0.98 < got["score"] <= 1


def test_base_against_brute_force(spark):
    rows = [("CC-BY cc by! cc  by",), ("general public license\ncc by nc",), (None,), ("",), ("é cc by é",), ("all rights all rights reserved " * 50,), ("cc" + " x" * 9000 + " by cc by",)]
    docs = spark.createDataFrame(rows, "text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    for r in scan_licences(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(r["text"])
        assert {*r["base_labels"].split(",")} <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([("cc by", 7, "mine")], "text string, score int, _licence string")
    (r,) = scan_licences(df).collect()
    assert r["_licence"] == "mine" and r["score"] == 0.5
    assert scan_licences(df.limit(0)).count() == 0


def test_whole_line_is_read():
    names = [f"lib-{i}-licence" for i in range(150)]
    line = "SPDX-License-Identifier: (" + " AND ".join(names) + ") OR MIT"
    assert len(line) > 2_000
    got = scan_text(f"{line}\nGPL-2.0")
    assert {*got["labels"].split(",")} == {*names, "mit"} and got["permissive"] is True
    got = scan_text(line.replace(")", "") + " see the file")
    assert {*got["labels"].split(",")} == {*names, "mit"} and got["permissive"] is None
    assert scan_text("(SPDX-License-Identifier: MIT) and then")["labels"] == "mit"
    assert scan_text("@license MIT (see the file)")["labels"] == "mit"


def test_ends_of_names():
    for line, labels, verdict in (
        ("SPDX-License-Identifier: MIT.", "mit", True), ("SPDX-License-Identifier: (MIT AND Apache-2.0", "apache-2.0,mit", None), ("SPDX-License-Identifier: GPL-2.0+ OR MIT: see", "gpl-2.0+,mit", True),
        ("under LicenseRef-Own-Terms, as agreed", "licenseref-own-terms", False), ("SPDX-License-Identifier: MIT OR LicenseRef-Own AND GPL-3.0", "gpl-3.0,licenseref-own,mit", True),
    ):
        got = scan_text(line)
        assert (got["labels"], got["permissive"]) == (labels, verdict), line


def expression(rng, depth=0):
    """A random expression and, by its shape alone, its names and verdict."""
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        name = rng.choice(("MIT", "GPL-2.0-only", "Apache-2.0", "Zlib", "EUPL-1.2", "LicenseRef-x"))
        good = name.lower().startswith(PERMISSIVE)
        if rng.random() < 0.2:
            return f"{name} WITH Some-exception", {name.lower(), "some-exception"}, good
        return name, {name.lower()}, good
    a, names_a, good_a = expression(rng, depth + 1)
    b, names_b, good_b = expression(rng, depth + 1)
    word = rng.choice(("AND", "OR"))
    return f"({a}) {word} ({b})", names_a | names_b, good_a and good_b if word == "AND" else good_a or good_b


def test_labels_score_and_verdict_against_brute_force():
    rng = random.Random(5)
    filler = ["some plain words here", "(see below)", "The MIT License", "Mozilla Public License", "cc by", "All rights reserved.", "public domain", "a general public license", ""]
    for _ in range(400):
        lines, labels, verdicts = [], {}, []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                text, names, good = expression(rng)
                lines.append(rng.choice(("// SPDX-License-Identifier: ", "* @license ", "SPDX-License-Identifier:")) + text + rng.choice(("", ".", " see the file", ";")))
                labels |= dict.fromkeys(names, 0.9)
                verdicts.append(good)
            else:
                lines.append(rng.choice(filler))
        text = "\n".join(lines)
        words = WORD.findall(text.lower())
        joined = f" {' '.join(words)} "
        for phrases, weight in ((BASE, 0.5), (NOTICES, 0.7)):
            for phrase, label in phrases.items():
                if f" {phrase} " in joined:
                    labels[label] = max(labels.get(label, 0), weight)
        open_part = 1.0
        for weight in labels.values():
            open_part *= 1 - weight
        got = scan_text(text)
        assert got["labels"] == ",".join(sorted(labels)), text
        assert abs(got["score"] - (1 - open_part)) < 1e-12 and got["permissive"] == (all(verdicts) if verdicts else None), text
