"""Recall and precision of op5's contexts and op8's entropy on planted cases among real texts."""

import base64
import random

from catalake.llm import pii, secrets

SF = "/root/testdata/sf0.001"


def texts_of(spark, n):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and length(text) > 200").select("text").orderBy("doc_id").limit(n).collect()
    return [r["text"] for r in rows]


def measured(found, planted):
    """Recall, and precision among found spans."""
    hit = len(found & planted)
    return hit / len(planted), hit / max(1, len(found))


def spread(rng, texts, notes):
    """Texts with each note between two of its words, and the place of each note's marked part [[...]]."""
    out, places = list(texts), []
    for note in notes:
        i = rng.randrange(len(out))
        at = rng.choice([0, *[k for k, c in enumerate(out[i]) if c == "\n"], len(out[i])])
        out[i] = f"{out[i][:at]}\n{note}\n{out[i][at:]}"
    for i, text in enumerate(out):
        while "[[" in text:
            a, b = text.index("[["), text.index("]]")
            text = text[:a] + text[a + 2 : b] + text[b + 2 :]
            places.append((i, a, b - 2))
        out[i] = text
    return out, set(places)


def test_planted_keys_are_found_and_decoys_left(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    makers = [
        lambda: base64.b64encode(rng.randbytes(24)).decode(), lambda: base64.urlsafe_b64encode(rng.randbytes(30)).decode(), lambda: "sk_live_" + "".join(rng.choices(letters, k=24)),
        lambda: rng.randbytes(20).hex().upper(), lambda: "".join(rng.choices(letters, k=40)),
    ]
    keys = [f"use [[{make()}]] here" for make in makers for _ in range(40)]
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(4, 9)))
    plain = [
        lambda: "-".join([rng.randbytes(4).hex(), *[rng.randbytes(2).hex() for _ in range(3)], rng.randbytes(6).hex()]), lambda: "_".join(word() for _ in range(5)), lambda: "/".join([word(), word(), "2024", "11", word(), word()]),
        lambda: "-".join([word(), word(), word(), str(rng.randint(1, 999)), word()]), lambda: "".join(str(rng.randint(0, 9)) for _ in range(26)), lambda: "=" * 40, lambda: "sha256-" + base64.b64encode(rng.randbytes(32)).decode(), lambda: "".join(word() for _ in range(5)),
    ]
    decoys = [f"see {make()} there" for make in plain for _ in range(40)]
    texts, planted = spread(rng, texts_of(spark, 60), keys + decoys)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], s["start"], s["end"]) for r in secrets.find_secrets(table).collect() for s in r["spans"] if s["kind"] == "entropy"}
    recall, precision = measured(found, planted)
    print(f"op8 entropy: recall {recall:.3f}, precision {precision:.3f} of {len(planted)}")
    assert recall >= 0.9 and precision >= 0.9


def test_planted_identifiers_are_discovered_by_context(spark):
    rng = random.Random(5)
    number = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    seed = [lambda: f"+1 (555) {number(3)}-{number(4)}", lambda: f"{rng.choice('abcdef')}{number(5)}@mail.example.org"]
    unseen = [lambda: f"ZX-{number(5)}-{number(2)}", lambda: f"{number(4)}/{number(4)}", lambda: f"M{number(8)}", lambda: f"0{number(3)}-{number(6)}"]
    contexts = ["reach me:", "contact number:", "your account", "home phone", "billing contact:"]
    notes = [f"{c} {rng.choice(seed)()} today" for c in contexts for _ in range(60)] + [f"{c} [[{make()}]] today" for c in contexts for make in unseen for _ in range(2)]
    # Decoys: the same shapes in contexts of no seed, of some seeds among many others, and without a context.
    notes += [f"{c} {make()} was shipped" for c in ("spare part", "lot number", "model name") for make in unseen for _ in range(6)]
    notes += [f"last entry {rng.choice(seed)()}" for _ in range(6)] + [f"last entry {make()}" for make in unseen for _ in range(6)] + [f"({make()})" for make in unseen for _ in range(6)]
    texts, planted = spread(rng, texts_of(spark, 60), notes)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], s["start"], s["end"]) for r in pii.find_personal_data(table).collect() for s in r["spans"] if s["kind"] == "context"}
    recall, precision = measured(found, planted)
    print(f"op5 contexts: recall {recall:.3f}, precision {precision:.3f} of {len(planted)}")
    assert recall >= 0.9 and precision >= 0.9
