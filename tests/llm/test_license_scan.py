import re

from tests.llm.data import documents, prose
from valora.llm import license_scan as L

TEXTS = [None, "", "All rights reserved. all RIGHTS reserved", "CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.",
         "GNU General Public License, version 3", "general public", "public license general", "x " * 60_000 + "cc by",
         "Released under the MIT License.", "rights reserved all", "ÉCC BY cc_by", prose(1, 300)]
TEXTS += [TEXTS[2]] * 2


def brute(text):
    ws = re.findall(L.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = []
    for t in L.TEMPLATES:
        for s in range(-len(t.words), len(ws)):
            if all(s + at >= 0 and ws[s + at: s + at + len(p)] == p for at, p in t.keys):
                share = sum(0 <= s + i < len(ws) and ws[s + i] == w for i, w in enumerate(t.words)) / len(t.words)
                found.append((t.label, t.base, s, round(1.0 if t.base else share, 9)))
    return len(ws), sorted(found)


def test_scan_equals_brute_force(spark):
    docs = documents(spark, TEXTS, clash="matches")
    out = L.scan(docs)
    assert out.columns == [*docs.columns, "n_words", "_matches"]
    for r in out.collect():
        got = sorted((m["label"], m["base"], m["start"], round(m["share"], 9)) for m in r["_matches"])
        assert (r["n_words"], got) == brute(r["text"])


def test_empty_table(spark):
    assert L.scan(documents(spark, ["a"]).limit(0)).count() == 0


def test_standard_gpl_notices(spark):
    notice = "the terms of the GNU {}General Public License as published by the Free Software Foundation{}version {} of the License"
    texts = [notice.format(a, e, n) for a, n in (("", 2), ("", 3), ("Affero ", 3)) for e in ("; either ", ", ")]
    got = {r["doc_id"]: {m["label"] for m in r["matches"] if not m["base"]} for r in L.scan(documents(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == [{x} for x in ("gpl-2.0", "gpl-3.0", "agpl-3.0") for _ in range(2)]
