import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing

TEXTS = ["a <|endoftext|> b", "<|startoftext|>Some words<|endoftext|>", "x<|endoftext|><|startoftext|>, été <|endoftext|>日本<|startoftext|>", "<|ENDOFTEXT|> <|endoftext |> <| endoftext|>", "no token", "", "a\n<|startoftext|>\tb"]


def test_ids_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    assert want[0] == [320, 49407, 321, 1]
    got = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in got} == {i: (0, len(x), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
