"""Corpus operators where they once looked at a part: secrets of few digits and beside allowed parts."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest

import corpus_pipeline
from citeloom.llm import pii, quality, secrets

SECRET = "qX7vB2nM9kL4pR8tW3zY6cF1"


def entropy_of(text):
    return [text[a:b] for a, _, b, kind in secrets.find_secrets(text) if kind == "entropy"]


@pytest.mark.parametrize(("alphabet", "n"), [(string.ascii_letters, 20), (string.ascii_letters + string.digits, 20), (string.ascii_letters + string.digits, 32), (string.ascii_lowercase, 40), (string.ascii_uppercase + "234567", 32)])
def test_secrets_of_few_digits(alphabet, n):
    r = random.Random(4)
    made = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(300)]
    few = [x for x in made if sum(c.isdigit() for c in x) < 3]
    # a window under the entropy limit is no candidate
    hot = [x for x in few if secrets.hot_windows(x, 20, 3.6)]
    assert len(hot) > 10 and sum(bool(entropy_of(f"key {x} end")) for x in hot) >= 0.97 * len(hot)


@pytest.mark.parametrize("beside", ["123e4567-e89b-12d3-a456-426614174000/{}", "sample_{}", "{}/0123456789", "{}-example", "abcdefghijklmnopqrstuvwxyz/{}", "path/to/the/sample/{}"])
def test_secret_beside_an_allowed_part(beside):
    found = entropy_of("see " + beside.format(SECRET) + " there")
    assert len(found) == 1 and SECRET in found[0]


def test_words_and_identifiers_are_no_secrets():
    runs = [
        "internationalisation/configuration_management", "getUserAccountDetailsFromRepository", "Donaudampfschifffahrtsgesellschaft", "some-ordinary-words-joined-by-hyphens-in-a-file-name",
        "src/main/java/org/apache/spark/sql/execution", "MAX_CONCURRENT_CONNECTIONS_PER_HOST", "anticonstitutionnellement-responsabilidad", "2024-01-15-12-34-56-7890123456",
        "123e4567-e89b-12d3-a456-426614174000", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "example0A1b2C3d4E5f6G7h8I9j", "your_api_key_goes_here_please",
    ]
    assert [r for r in runs if entropy_of(r)] == []


def test_long_runs_take_linear_time():
    assert entropy_of("9" * 200_000 + "/" + "sample" * 20_000 + "/" + SECRET) == ["/" + SECRET]


def test_near_stage_keeps_every_text_of_a_document(spark):
    one, two = "one text with enough words of its own to be told from others", "quite another piece that shares nothing with what stands above it"
    rows = [(1, one, "b"), (1, one, "a"), (1, two, "c"), (2, "a third document that stands alone among all of these rows", "a")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for shuffled in (docs, docs.orderBy("source"), docs.orderBy(docs["source"].desc())):
        got = corpus_pipeline.near_stage(spark, shuffled, "").collect()
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == sorted([(1, one, "a"), (1, two, "c"), rows[3]])


@pytest.mark.parametrize("few", [20_000, 5])
def test_quality_cut_is_of_all_labelled_rows(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_SCORES", few)
    monkeypatch.setattr(quality, "BINS", 7)
    r = random.Random(6)
    words = "river stone quiet morning light over small town where people walk home".split()
    rows, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(words) + ("***" if r.random() < (i % 10) / 12 else "") for _ in range(r.randint(20, 90)))
        rows.append((i, text))
        labels.append((i, int(r.random() > (i % 10) / 10), 0))
    rows += [(1000 + i, "the very same text") for i in range(60)]
    labels += [(1000 + i, i % 2, 0) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(10**6 + i, 0, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    ranking = quality.train(docs, known, max_labelled=25)
    used = [(t.encode(), q) for (d, t), (_, q, _) in zip(rows, labels, strict=True) if zlib.crc32(str(d).encode()) % 4 != 2]
    raw = sorted(ranking.raw(np.array([quality.features(t) for t, _ in used])))
    bad = sum(q == 0 for _, q in used)
    assert ranking.threshold == pytest.approx((raw[bad - 1] + raw[bad]) / 2, abs=1e-9)


def test_phone_of_single_digits(spark):
    text = "call +4 - 9 - 1 - 7 - 2 - 3 - 4 - 5 - 6 - 7 now"
    row = pii.pii_spans(spark.createDataFrame([(1, text), (2, "a + b, + 4 - 9")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_phone"] for r in row] == [1, 0]
    assert row[0]["base_sha256"] == hashlib.sha256(f"phone:5:{len(text) - 4}".encode()).hexdigest()


def plain_features(text):
    words = text.encode().split()
    raw = text.encode()
    n, size = len(words), max(1, len(raw))
    upper = sum(65 <= b < 91 for b in raw)
    letters = upper + sum(97 <= b < 123 or b >= 128 for b in raw)
    stops = sum(chr(b) in ".,;:!?'\"()-" for b in raw)
    symbols = sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-" for b in raw) / size
    share, distinct = upper / max(1, letters), len({*words})
    repeat = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    herdan = np.log(distinct + 1) / np.log(n + 1) if n else 1.0
    mean = (size - sum(b in b" \n\t\r" for b in raw)) / max(1, n)
    return [
        min(symbols, 0.05) * 20, symbols, min(share, 0.3), max(0, share - 0.3), sum(48 <= b < 58 for b in raw) / size, min(repeat, 0.1) * 10, repeat, 1 - herdan, max(0, 0.85 - herdan),
        1 - distinct / max(1, n), min(mean, 15) / 15, np.log1p(n) / 10, stops / size, raw.count(b"\n") / size, float(n == 0),
    ]


def test_quality_features_and_fit_match_plain_python():
    r = random.Random(9)
    texts = ["", "  \n", "ÜBER straße 12, 漢字!", "*** &&& Same Same Same"] + [" ".join(r.choice(["river", "Stone", "of", "***", "42", "day."]) for _ in range(r.randint(1, 60))) for _ in range(120)]
    x = np.array([quality.features(t.encode()) for t in texts])
    assert np.allclose(x, [plain_features(t) for t in texts], atol=1e-12)
    good = np.array([t.count("***") * 4 < len(t.split()) + r.random() for t in texts])
    made = quality.fit_ranking(x, good, pairs_each=5, ridge=1e-3)
    # the optimum of the penalised likelihood of the preference pairs: its gradient is nought
    z = [[(v - m) / s for v, m, s in zip(row, made.mean, made.scale, strict=True)] for row in x]
    up, down = [i for i, g in enumerate(good) if g], [i for i, g in enumerate(good) if not g]
    few, many = (down, up) if len(down) <= len(up) else (up, down)
    pairs = [(a, many[(i * 7919) % len(many)]) for i, a in enumerate(a for a in few for _ in range(5))]
    gradient = [-1e-3 * w for w in made.weights]
    for a, b in pairs:
        best, worst = (b, a) if few is down else (a, b)
        d = [p - q for p, q in zip(z[best], z[worst], strict=True)]
        wrong = 1 / (1 + np.exp(sum(w * v for w, v in zip(made.weights, d, strict=True))))
        gradient = [g + wrong * v / len(pairs) for g, v in zip(gradient, d, strict=True)]
    assert max(map(abs, gradient)) < 1e-8
