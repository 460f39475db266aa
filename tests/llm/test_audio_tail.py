from gridloom.llm import audio_features as op


def test_the_end_of_a_payload_enters_the_features(spark):
    rows = [(10 * k + last, "a" * (576 * k - 8) + chr(97 + 20 * last) * 8) for k in range(1, 9) for last in (0, 1)]
    got = {r["doc_id"]: r for r in op.audio_features(op.media_column(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k in range(1, 9):
        a, b = got[10 * k], got[10 * k + 1]
        assert a["frames"] == b["frames"] and (a["frames"] - 1) * op.HOP + op.FRAME >= 288 * k > (a["frames"] - 2) * op.HOP + op.FRAME
        assert a["tensors"] != b["tensors"]
        assert op.read_tensors(bytes(a["tensors"]))["end_s"].to_pylist()[-1] == 288 * k / op.RATE
