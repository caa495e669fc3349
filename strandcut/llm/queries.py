"""All queries of the subpackage, registered on import."""

from strandcut.llm import (  # noqa: F401
    fingerprints, jaccard, licences, manifest, mixing, near_vectors, pieces, pii, quality, sharding, urls, vectors, whitening,
)
from strandcut.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
