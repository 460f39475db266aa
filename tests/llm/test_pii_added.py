import random
import re
import time

from gridloom.llm import pii

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LENGTH = {country: n for n, names in pii.IBAN_LENGTHS.items() for country in names.split()}


def alnum(text, i):
    return 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()


def walked(text, at, most):
    """Ends after each of up to ``most`` steps of an optional space and a capital or digit."""
    ends = []
    while len(ends) < most:
        step = 2 if text[at : at + 1] == " " else 1
        c = text[at + step - 1 : at + step]
        if not c or c not in UPPER + DIGITS:
            break
        at += step
        ends.append(at)
    return ends


def ibans(text):
    out, i = [], 0
    while i < len(text):
        head = text[i : i + 4]
        end = None
        if not alnum(text, i - 1) and len(head) == 4 and all(c in UPPER for c in head[:2]) and all(c in DIGITS for c in head[2:]):
            n = LENGTH.get(head[:2], 0)
            ends = walked(text, i + 4, n - 4)
            if n and len(ends) == n - 4 and not alnum(text, ends[-1]):
                end = ends[-1]
            else:
                ends = walked(text, i + 4, 30)
                if len(ends) >= 11 and not alnum(text, ends[-1]):
                    end = ends[-1]
        if end is None:
            i += 1
            continue
        bare = text[i:end].replace(" ", "")
        if 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            out.append((i, end))
        i = end
    return out


def ssns(text):
    out = []
    every = list(re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text))
    for m, last, following in zip(every, [0, *(x.end() for x in every)], [*(x.start() for x in every[1:]), len(text)], strict=False):
        near = text[max(last, m.start() - pii.REACH) : m.start()] + " " + text[m.end() : min(following, m.end() + pii.REACH)]
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000" and re.search(r"(?i)\b(?:ssn|social|security|taxpayer)", near):
            out.append((m.start(), m.end()))
    return out


def valid_iban(rng):
    country = rng.choice(list(LENGTH))
    body = "".join(rng.choice(UPPER + DIGITS * 3) for _ in range(LENGTH[country] - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    bare = f"{country}{check:02d}{body}"
    return bare if rng.random() < 0.5 else " ".join(bare[i : i + 4] for i in range(0, len(bare), 4))


def made(rng):
    parts = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.randrange(9)
        if kind == 0:
            parts.append(valid_iban(rng))
        elif kind == 1:
            parts.append(valid_iban(rng)[: rng.randint(5, 20)] + rng.choice(["", "X", "9", ",", "é"]))
        elif kind == 2:
            parts.append(rng.choice(["ssn ", "social number ", "", "x-"]) + f"{rng.choice([0, 123, 666, 899, 900]):03d}-{rng.choice([0, 45]):02d}-{rng.choice([0, 6789]):04d}" + rng.choice(["", "-1", "5", "."]))
        elif kind == 3:
            parts.append(rng.choice(["a.b@c.de", "1.2.3.4", "+49 30 1234567", "4111111111111111", "x4111111111111111@y.zz"]))
        else:
            parts.append(rng.choice(["word", "A", "42", "\U0001f600", "﻿", "été", "﻿﻿", "a-b", "\n"]))
    return rng.choice(["", " "]).join(parts) if rng.random() < 0.2 else " ".join(parts)


def plain_masked(text, found):
    spans = sorted((s, -e, k) for k, s, e in found)
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out.append(text[at:s] + f"[{k.upper()}]")
        at = max(at, -e)
    return "".join(out) + text[at:]


def test_added_kinds_and_masking_by_plain_scans(spark):
    rng = random.Random(11)
    texts = [made(rng) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: [(x["kind"], x["start"], x["stop"]) for x in r["found"]] for r in pii.personal_data(df).collect()}
    seen = 0
    for i, text in enumerate(texts):
        for kind, want in (("iban", ibans(text)), ("ssn", ssns(text))):
            assert [(s, e) for k, s, e in found[i] if k == kind] == want, text
            seen += len(want)
    assert seen > 300
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked == {i: plain_masked(t, found[i]) for i, t in enumerate(texts)}


def test_a_megabyte_of_matches(spark):
    text = "m@a.bc 10.0.0.1 " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert pii.personal_data(df).selectExpr("size(found) AS n", "found[119999].stop AS z").collect() == [(120_000, len(text) - 1)]
    assert pii.masked(df).collect()[0]["text"] == "[EMAIL] [IP] " * 60_000
    assert time.time() - began < 60
