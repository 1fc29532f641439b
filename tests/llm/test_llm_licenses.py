"""License scans against a brute-force version over places and diagonals."""

import random
import re

import pytest

from stakeline.llm import licenses
from stakeline.llm.licenses import Template

DOCS = "doc_id long, text string, n_words string, spans int, copy int, digest string"


def split(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def spans(text, templates, gram=3, slack=3, least=0.8):
    w, found = split(text), set()
    notices = []
    for k, t in enumerate(templates):
        known = split(t.text)
        if not known:
            continue
        size = min(gram, len(known))
        hits = {}
        for o in range(len(known) - size + 1):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == known[o : o + size]:
                    hits.setdefault(p - o, set()).add(o)
        groups = [[d] for d in sorted(hits)]
        if not t.phrase:
            for d in sorted(hits):
                if groups and len(groups) > len(hits) and d - groups[-1][-1] <= slack:
                    groups[-1].append(d)
                else:
                    groups.append([d])
        for g in groups:
            first = min(d + min(hits[d]) for d in g)
            last = max(d + max(hits[d]) + size - 1 for d in g)
            covered = len({x for d in g for o in hits[d] for x in range(o, o + size)})
            score = 2 * min(covered, last - first + 1) / (len(known) + last - first + 1)
            if score >= (1 if t.phrase else least):
                if t.phrase:
                    found.add((first, last, t.label, True, score))
                else:
                    notices.append((first, last, k, t.label, score, len(known)))
    islands = []
    for n in sorted(notices):
        if islands and n[0] <= max(m[1] for m in islands[-1]):
            islands[-1].append(n)
        else:
            islands.append([n])
    for island in islands:
        first, last, _, label, score, _ = min(island, key=lambda n: (-n[4], -n[5], n[3], n[0]))
        found.add((first, last, label, False, score))
    return sorted(found)


def texts():
    rng = random.Random(8)
    filler = ["the", "of", "license", "and", "all", "rights", "general", "public", "software", "é", "K"]
    rows = [None, "", " .,", "cc-by", "CC BY cc by", "a cc by", "cc by.", "all rights reserved", "all rights  RESERVED all"]
    rows += ["general public license " * 400, "K cc by KK", "cC\tBy\n", "all rights re served", "cc"]
    for t in licenses.TEMPLATES:
        words = t.text.split()
        rows.append(" ".join(rng.choices(filler, k=20)) + " " + t.text + " " + " ".join(rng.choices(filler, k=9)))
        if len(words) > 8:
            at = len(words) // 2
            rows.append(" ".join([*words[:at], "really", "so", *words[at:]]))
            rows.append(" ".join([*words[:at], *words[at + 1 :]]) + ". " + t.text)
            rows.append(" ".join(words[: len(words) // 2]))
            rows.append(" ".join(words[-6:] + words[:-6]))
    return rows + [" ".join(rng.choices(filler, k=300)) for _ in range(10)]


def test_scan_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [rows[4], rows[4], (None, "cc by"), (None, "cc by"), (None, None), (7, "another text, cc by")]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS).repartition(3)
    found = [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]]) for r in licenses.scan(frame).collect()]
    want = [(i, len(split(t)), spans(t, licenses.TEMPLATES)) for i, t in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("gram", [1, 4])
def test_scan_with_other_templates(spark, gram):
    templates = [
        Template("x", "Élan vital", phrase=True), Template("one", "word", phrase=True), Template("none", "- -"),
        Template("long", "one two three four five six seven eight nine ten"),
    ]
    rows = [(1, "élan VITAL Élan Vital word"), (2, "one two three four six seven eight nine ten"), (3, "Word. word")]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in licenses.scan(frame, templates=templates, gram=gram).collect()}
    assert found == {i: spans(t, templates, gram) for i, t in rows}


def test_labels_of_documents(spark):
    rows = [(1, "Licensed under the GNU General Public License, version 3. cc by, cc by"), (2, None), (3, "plain")]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.label_documents(frame).collect()}
    assert found == {
        1: (13, 3, 4, 11, "cc-by,gpl", "cc-by,gpl,gpl-3.0", 1.0),
        2: (0, 0, None, None, "", "", 0.0),
        3: (1, 0, None, None, "", "", 0.0),
    }
    assert licenses.label_documents(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame, templates=[Template("x", "a " * (licenses.TEMPLATE_WORDS + 1))])


def test_scan_needs_no_python(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "concat('cc by ', id) AS text")
    shown = licenses.label_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", shown)
