"""Licence scan against a plain TF-IDF cosine and a walk up the directories."""

import math
import re

from newsloom.llm import licenses

ROWS = "path string, text string, license string, own string, line string"
FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "# no notice\ncode here"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    ("a/b/d/COPYING", "some preface\nThis work is licensed under the GNU General Public License, version 3.\n" + "more words of it " * 30), ("a/b/d/e/f/z.txt", "plain"), ("top.txt", "plain"),
    ("q/long.txt", "filler words " * 3000 + "\nLicensed under CC BY-NC 4.0.\n" + "the license of the river " * 2000), ("q/near.txt", "released under the MIT license"),
    ("q/not.txt", "the story of a license that was not released under anything\n\n \n"), (None, "Released under the MIT License."), (None, None), ("a/b/null.txt", None), ("a/b/c/", ""),
]


def terms(line):
    return {w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in line.lower().split()) if w}


def plain(threshold=0.7):
    texts = list(dict.fromkeys(FILES))
    lines = [(k, n, x) for k, (_, t) in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if t is not None]
    pairs = licenses.template_terms(licenses.TEMPLATES)
    templates = {}
    for t, w in pairs:
        templates.setdefault(t, set()).add(w)
    weight = {w: math.log(1 + len(lines) / (1 + sum(w in terms(x) for _, _, x in lines))) for _, w in pairs}
    rare = max(weight.values())
    own = {}
    for k, n, x in lines:
        length = math.sqrt(sum(weight.get(w, rare) ** 2 for w in terms(x)))
        for t, words in templates.items():
            if both := words & terms(x):
                score = sum(weight[w] ** 2 for w in both) / length / math.sqrt(sum(weight[w] ** 2 for w in words))
                if score >= threshold:
                    own[k] = min(own.get(k, (9,)), (-score, n, t.split("#")[0]))
    folders = {}
    for k, (path, text) in enumerate(texts):
        if k in own and path and "/" in path and (re.search(licenses.LICENCE_FILE, path) or "\n" not in text.strip()):
            folder = path.rpartition("/")[0]
            folders[folder] = min(folders.get(folder, (9,)), (own[k][0], path, own[k][2]))
    found = set()
    for k, (path, text) in enumerate(texts):
        up, got = (path or "").rpartition("/")[0], None
        while up and not got:
            got, up = folders.get(up, (0, 0, None))[2], up.rpartition("/")[0]
        found.add((path, own[k][2] if k in own else got, "own" if k in own else "inherited" if got else None, own[k][1] if k in own else None))
    return found


def test_scan(spark):
    frame = spark.createDataFrame([(*f, "x", "y", "z") for f in FILES], ROWS)
    found = licenses.scan(frame).collect()
    assert {(r["path"], r["license"], r["via"], r["license_line"]) for r in found} == plain()
    assert licenses.scan(frame).columns == ["path", "own", "line", "license", "via", "license_line", "score"]
    by = {r["path"]: (r["license"], r["via"]) for r in found if r["path"]}
    assert by["a/b/c/x.py"] == ("MIT", "inherited") and by["a/b/d/e/f/z.txt"] == ("GPL-3.0", "inherited") and by["q/near.txt"] == ("MIT", "own")


def test_repeats_and_empty(spark):
    frame = spark.createDataFrame([(f, t) for f, t in FILES * 2], "path string, text string")
    assert licenses.scan(frame).count() == 2 * len(FILES)
    assert licenses.scan(frame.limit(0)).count() == 0
