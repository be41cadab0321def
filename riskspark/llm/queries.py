"""The operators' queries; importing the modules registers them."""

from riskspark.llm import bpe, langid, linededup, merkle, mixing, pii, quality, secrets, sharding, simhash, topk, urlmodel, whitening  # noqa: F401
from riskspark.llm.common import ORACLES, QUERIES  # noqa: F401
