"""The secret scan against its SQL on texts with private keys, which no given table holds."""

import base64

import duckdb
import numpy as np
import pandas as pd
import pytest
from tests.compare import differences
from tests.llm.tables import DOCUMENTS
from twinfold.llm import secret_scan
from twinfold.llm.oracle import oracle_sql

BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def _compare(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.array(texts, dtype="string")}))
    report = secret_scan.report(spark.createDataFrame(rows, DOCUMENTS).repartition(4))
    assert differences(report, con, oracle_sql()["op8_secret_scan"]) == []
    return report


def test_whole_keys(spark):
    body = base64.b64encode(bytes(i * i % 251 for i in range(900))).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n"
    joins = ["\n", "\r\n", "\\n", "\\\\n", " ", "\n    ", '\\n" +\n    "', "\n> ", "`\n"]
    keys = [j.join([BEGIN, *lines, END]) for j in joins] + [j.join([BEGIN, *lines]) for j in joins]
    keys += [f"{BEGIN}\n{headers}" + "\n".join([*lines, END]), f"{BEGIN}\n{headers}" + "\n".join(lines), f"{BEGIN}{body}{END}", BEGIN, BEGIN + END]
    keys += ["\n".join([BEGIN, "Ab1", "cD+/=="]), "\n".join([BEGIN, *lines[:3], lines[3][:7]]), f"{BEGIN}\nProc-Type: 4", f"{BEGIN}\n{headers}{BEGIN}"]
    tails = ["", " and so on.", "\nThe rest stays, all of it.", "\nshort\n", '"', " \\", "\n" + BEGIN]
    texts = [f"é see {key}{tail}" for key in keys for tail in tails] + [f"{a} and {b}" for a in keys for b in keys[::3]]
    found = _compare(spark, [*texts, None, ""]).select("spans").collect()
    assert sum("private_key" in r["spans"] for r in found) == len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_of_keys(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [BEGIN, END, "\n", "\n", "\\n", "\\", " ", "\t", '"', "'", "`", ",", "+", "#", ">", "*", "|", "-", "=", "==", "A", "nrt", "Ab1/", "Q" * 15, "Q" * 16, "Zz9+" * 16,
            "Proc-Type: 4,ENCRYPTED", "X-: ", "word", "é", "\r", "\f", "password=abcdef1"]
    weights = np.array([4.0] * 2 + [3.0] * 3 + [1.0] * (len(pool) - 5))
    texts = [BEGIN * int(rng.random() < 0.8) + "".join(rng.choice(pool, rng.integers(0, 14), p=weights / weights.sum())) for _ in range(3000)]
    _compare(spark, texts)
