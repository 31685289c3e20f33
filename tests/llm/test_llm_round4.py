"""Words that the token store's encoder has met are not tokenized again when its memory of chunks is renewed."""

import public_tokenizers

from harborscan.llm import token_store


def test_stems_outlive_chunks(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_CHUNKS", 2)
    coder = token_store.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts = [b"Harbor, harbor! lights", "Élève harbor; élève".encode(), b"harbor? HARBOR", b"lights: harbor"]
    want = [x + coder.end for x in coder._whole([t.decode() for t in texts])]
    seen, letters = [], coder._letters
    monkeypatch.setattr(coder, "_letters", lambda w: seen.append(w) or letters(w))
    assert [coder.encode([t])[0] for t in texts] == want
    assert sorted(seen) == sorted(set(seen))
