from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from samples import odd_rows

from shelfsight.llm import language

SAID = {
    "en": "the people of this town and that river have been with us when they were young and there was light",
    "fr": "les gens de cette ville et de ces rivieres sont avec nous quand ils etaient jeunes dans la lumiere",
    "de": "die leute dieser stadt und jener fluesse sind mit uns gewesen als sie jung waren und es licht gab",
    "es": "la gente de esta ciudad y de aquellos rios ha estado con nosotros cuando eran jovenes y habia luz",
}


def rows(count=80):
    rng = random.Random(5)
    out = []
    for i in range(count):
        code = ["en", "fr", "de", "es"][i % 4]
        text = " ".join(rng.choices(SAID[code].split(), k=30))
        # Every tenth document declares another language than it is written in, some none at all.
        said = "en" if i % 10 == 9 else None if i % 7 == 6 else code + "-XX" if i % 3 else code.upper()
        out.append((i, text, said, f"www.site{i % 4}.{'com' if code == 'en' else code}", code))
    return out


def found(spark, table):
    docs = spark.createDataFrame(table, "doc_id long, text string, said string, host string, code string")
    return language.identified(docs, F.col("text"), F.col("said"), F.col("host"))


def test_texts_decide_against_a_wrong_declaration(spark):
    result = found(spark, rows()).collect()
    assert all(r.accepted and r.language == r.code for r in result)


def test_evidence_beside_the_text_decides_a_short_one(spark):
    table = [*rows(), (100, "la", None, "www.site3.es", "es"), (101, "la", None, "www.site1.fr", "fr")]
    result = {r.doc_id: r.language for r in found(spark, table).collect()}
    assert result[100] == "es" and result[101] == "fr"


def test_noise_is_rejected(spark):
    table = [*rows(800), (1000, "12 34 !! 56", "en", "a.com", "en"), (1001, "xq zzkw vvqx jjqk wxzq kkqj " * 8, None, "a.com", "en"), (1002, None, None, None, "en")]
    result = {r.doc_id: r for r in found(spark, table).collect()}
    assert not any(result[i].accepted for i in (1000, 1001, 1002))
    assert all(result[i].language is None for i in (1000, 1001, 1002))


def test_odd_rows(documents):
    docs = documents(odd_rows())
    for df in (docs, docs.where("false")):
        result = language.identified(df, F.col("text"), F.col("lang"), F.col("source"))
        assert result.columns == [*docs.columns, "language", "confidence", "accepted"]
        assert result.count() == df.count()


def test_shares_are_those_of_all_documents(spark):
    """The host's share by hand: a text without any sign takes the language of its host."""
    table = [(i, SAID["fr"] if i % 4 else SAID["en"], "fr" if i % 4 else "en", "h.org", "") for i in range(40)]
    table.append((50, "zu", None, "h.org", ""))
    result = {r.doc_id: r for r in found(spark, table).collect()}
    assert result[50].confidence <= 1 and result[1].language == "fr" and result[0].language == "en"


def test_reserved_names_are_refused_and_others_replaced(documents):
    import pytest

    docs = documents(odd_rows())
    with pytest.raises(ValueError, match="_host"):
        language.identified(docs.withColumn("_host", F.lit(1)), F.col("text"), F.col("lang"), F.col("source"))
    again = language.identified(docs.withColumn("language", F.lit("x")), F.col("text"), F.col("lang"), F.col("source"))
    assert again.columns == [*docs.columns, "language", "confidence", "accepted"]
    assert again.where("language = 'x'").count() == 0


def posterior(table, languages=language.LANGUAGES):
    """(language, confidence, accepted) of each row, by plain counting."""
    said = [(d or "")[:2].lower() for _, _, d, _, _ in table]
    hosts = [(h or "").lower() for *_, h, _ in table]
    domains = [(re.findall(r"([^.]+\.[^.]+)$", h) or [""])[0] for h in hosts]
    ends = [h.rsplit(".", 1)[-1] if "." in h else "" for h in hosts]
    tri = [language.cells(t or "").tolist() for _, t, *_ in table]
    counts = {k: Counter() for k in languages}
    for code, found in zip(said, tri, strict=True):
        if code in counts:
            counts[code].update(found)

    def mean(found, k):
        whole = sum(counts[k].values()) + language.ALPHA * language.CELLS
        return sum(math.log((counts[k][c] + language.ALPHA) / whole) for c in found) / len(found) + math.log(language.CELLS)

    like, over = [], []
    for found in tri:
        means = [mean(found, k) for k in languages] if found else [0.0] * len(languages)
        like.append([m * min(len(found), language.EVIDENCE) for m in means])
        over.append(max(means) + language.SLACK / len(found) ** 0.5 if found else -99.0)
    looks = [x.index(max(x)) for x in like]
    sure = [i for i, o in enumerate(over) if o >= language.CHANCE]
    every = Counter(looks[i] for i in sure)
    size = len(languages)
    prior = [(every[k] + 1) / (len(sure) + size) for k in range(size)]

    def grouped(keys):
        out = defaultdict(Counter)
        for i in sure:
            out[keys[i]][looks[i]] += 1
        return out

    by_host, by_domain, by_code, by_end = (grouped(x) for x in (hosts, domains, said, ends))
    out = []
    for i in range(len(table)):
        up = prior
        if domains[i] and domains[i] in by_domain:
            n = by_domain[domains[i]]
            up = [(n[k] + language.DOMAIN_WEIGHT * prior[k]) / (sum(n.values()) + language.DOMAIN_WEIGHT) for k in range(size)]
        mine = prior
        if hosts[i] in by_host:
            n = by_host[hosts[i]]
            mine = [(n[k] + language.HOST_WEIGHT * up[k]) / (sum(n.values()) + language.HOST_WEIGHT) for k in range(size)]
        score = [x + math.log(m) for x, m in zip(like[i], mine, strict=True)]
        for known, key in ((by_code, said[i]), (by_end, ends[i])):
            if key and key in known:
                score = [x + math.log((known[key][k] + 0.5) / (every[k] + 50.0)) for k, x in enumerate(score)]
        top = max(score)
        confidence = 1 / sum(math.exp(x - top) for x in score)
        accepted = over[i] >= language.CHANCE and confidence >= language.LEAST
        out.append((languages[score.index(top)] if accepted else None, confidence, accepted))
    return out


def test_posteriors_equal_plain_counting(spark):
    rng = random.Random(8)
    table = []
    for i, text, said, host, code in rows(160):
        words = text.split()[: rng.choice([1, 2, 30])]
        table.append((i, " ".join(words), said, rng.choice([host, f"a{i % 3}.site.org", "plain", None]), code))
    table += [(1000, None, "en", "x.com", ""), (1001, "12", None, None, ""), (1002, "la", "zz", "www.site3.es", "")]
    got = {r.doc_id: (r.language, r.confidence, r.accepted) for r in found(spark, table).collect()}
    for row, (name, confidence, accepted) in zip(table, posterior(table), strict=True):
        assert got[row[0]][::2] == (name, accepted), row
        assert math.isclose(got[row[0]][1], confidence, rel_tol=1e-9)
