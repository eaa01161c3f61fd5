from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import odd_rows, said

from shelfsight.llm import lines

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "left_words", "kept", "text"]


def plain(line):
    spaced = re.sub("[\\x20\\x09-\\x0D]+", " ", line).strip(" ").lower()
    return re.sub("[0-9]+", "0", spaced)


def brute(rows, documents, share):
    held = Counter(host for _, _, host in rows)
    found = Counter((host, x) for _, t, host in rows for x in {plain(line) for line in (t or "").split("\n") if WORD.search(line)})
    out = []
    for doc, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        split = text.split("\n")
        spoken = [x for x in split if WORD.search(x)]
        runs = Counter(zip(words, words[1:], words[2:]))
        again = {p for i, run in enumerate(zip(words, words[1:], words[2:])) if runs[run] > 1 for p in (i, i + 1, i + 2)}
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)

        def goes(x):
            n = found[host, plain(x)]
            return bool(WORD.search(x)) and n > documents and n > int(held[host] * share)

        left = [x for x in split if not goes(x)]
        removed = sum(map(goes, split))
        left_words = sum(len(WORD.findall(x)) for x in left)
        kept = not failed and (removed == 0 or (left_words >= 50 and 100 * left_words >= 50 * len(words)))
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((doc, len(words), sum(map(len, words)), symbols, len(spoken) - len(set(spoken)), len(again), failed, removed, left_words, kept, "\n".join(left)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    out = []
    for i in range(80):
        body = [said(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            body.insert(rng.randint(0, len(body)), rng.choice(["Read more  here", "READ MORE HERE ", "\tread more here"]))
        if i % 3 == 0:
            body.append(f"page {i} of {i * 7} $ # & | < > * %")
        if i % 5 == 0:
            body += [body[0]] * 3
        if i % 7 == 0:
            body += ["", " \t", "la la la la la la la la"]
        out.append((i, "\n".join(body), "hot" if i % 4 else None))
    return out + [(1000 + i, "a copied text\nof two lines", "copies") for i in range(20)] + odd_rows()


@pytest.mark.parametrize("documents_,share", [(10, 0.001), (3, 0.3)])
def test_rules_equal_brute_force(spark, documents, documents_, share):
    given = rows()
    found = lines.line_rules(documents(given), documents=documents_, share=share)
    assert found.columns == [*documents(given).columns, "rules"]
    got = sorted((tuple([r.doc_id, *[r.rules[f] for f in FIELDS]]) for r in found.collect()), key=str)
    want = brute(given, documents_, share)
    assert got == want
    assert any(r[7] for r in want) and any(r[7] and r[9] for r in want) and any(r[9] and not r[7] for r in want)


def test_without_texts_and_with_another_host(spark, documents):
    docs = documents(rows())
    found = lines.line_rules(docs, host=F.lit("one"), texts=False)
    assert "text" not in found.columns and "text" not in found.schema["rules"].dataType.names
    want = brute([(i, t, "one") for i, t, _ in rows()], lines.DOCUMENTS, lines.SHARE)
    assert sorted(((r.doc_id, r.rules.removed, r.rules.kept) for r in found.collect()), key=str) == sorted(((r[0], r[7], r[9]) for r in want), key=str)


def test_a_depleted_document_goes_and_a_clean_one_stays(spark, documents):
    rng = random.Random(9)
    menu = "\n".join(said(rng, 12) for _ in range(6))
    own = [said(rng, 80) for _ in range(12)]
    docs = documents([(i, f"{menu}\n{text}", "a") for i, text in enumerate(own)] + [(50, f"{menu}\nlittle else", "a"), (51, own[0] + " once more", "a")])
    kept = {r.doc_id: r.rules for r in lines.line_rules(docs).collect()}
    assert all(kept[i].kept and kept[i].text == own[i] for i in range(12))
    assert not kept[50].kept and not kept[50].base_failed and kept[50].removed == 6
    assert kept[51].kept and kept[51].removed == 0


def test_no_rows_and_a_clashing_name(spark, documents):
    none = documents([(1, "x", "a")]).where("false")
    assert lines.line_rules(none).count() == 0
    with pytest.raises(ValueError):
        lines.line_rules(none.withColumn("rules", F.lit(1)))
    clash = none.withColumns({c: F.lit(1) for c in ("row", "host", "lines", "base", "own", "gone", "removed", "_line")})
    assert lines.line_rules(clash).count() == 0
