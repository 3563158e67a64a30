"""What a worker holds while it tokenises."""

import random
import tracemalloc

from cadenza.llm import packing


def test_a_chunk_of_texts_is_tokenised_in_bounded_memory():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(600)) for _ in range(400)]
    table = packing._pieces(packing.TOKENIZER)
    table.encode(texts[:50])
    tracemalloc.start()
    n = sum(len(ids) for _, chunk in packing.text_chunks(texts) for ids in table.encode(chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1_200_000 and n >= 240_000 and peak < 16_000_000, peak
