"""Private keys are masked whole, not only their first line."""

import random

from pyspark.sql import functions as F

from integrity_spark.llm import secrets


def test_private_key_bodies_are_masked(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choices("ABCDEFGHIJKLmnopqrstuvwxyz0123456789+/", k=n))
    body = [*(line(64) for _ in range(12)), line(30) + "=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n"
    long = [line(64) for _ in range(20_000)]
    cases = {
        "before\n" + "\n".join([begin, *body, end]) + "\nafter it": "before\n[SECRET]\nafter it",
        "\r\n".join([begin, *body, end]): "[SECRET]",
        begin + "\n" + head + "\n".join([*body, end]) + " x": "[SECRET] x",
        'k = "' + "\\n".join([begin, *body, end]) + '\\n"': 'k = "[SECRET]\\n"',
        "a " + " ".join([begin, *body, end]) + " b": "a [SECRET] b",
        "\n".join(["> " + x for x in (begin, *body, end)]): "> [SECRET]",
        "\n".join([begin, *body]) + "\n\nThe text goes on.": "[SECRET]\n\nThe text goes on.",
        "\n".join([begin, *body[:12], line(10)]): "[SECRET]",
        "\n".join([begin, *body[:12]]) + "\nThe text goes on.": "[SECRET]\nThe text goes on.",
        "\n".join([begin, *body, end, begin, *body, end]) + " é": "[SECRET]\n[SECRET] é",
        f"a key starts with {begin} as told.": "a key starts with [SECRET] as told.",
        "\n".join([begin, *long, end]) + "\nafter": "[SECRET]\nafter",
        "\n".join([begin, *long]) + "\nThe text goes on.": "[SECRET]\nThe text goes on.",
        "\\n".join([begin, *long]) + "\nThe text goes on.": "[SECRET]\nThe text goes on.",
    }
    pem = tuple(r for r in secrets.RULES if r.kind == "pem")
    found, _ = secrets.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), rules=pem)
    got = {r.doc_id: r.t for r in found.select("doc_id", secrets.redacted(F.col("text"), F.col("findings")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert pem[0].key == "pem@3"
