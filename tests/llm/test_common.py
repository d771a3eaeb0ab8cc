"""What Python workers keep between tasks is let go when another operator's functions run."""

from __future__ import annotations

import public_tokenizers

from tessera.llm import bpe, common, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_workers_keep_only_what_the_operator_needs():
    first = bpe.encoder(PATH)
    toxicity.INDEXES["x"] = None
    common.let_go_for("tessera.llm.packing")
    assert not toxicity.INDEXES and bpe.encoder(PATH) is first
    toxicity.INDEXES["x"] = None
    common.let_go_for("tessera.llm.toxicity")
    assert "x" in toxicity.INDEXES and bpe.encoder.cache_info().currsize == 0
    common.let_go_for("tessera.llm.quality")
    assert not toxicity.INDEXES

