"""docloom: tables of documents to typed rows and clean markdown, on DataFrames.

    from docloom import normalize, ChunkConfig, ExtractConfig, MergeConfig

    chain = normalize().chunk(ChunkConfig("row")).extract(ExtractConfig(...)).merge(MergeConfig("dedupe", ...))
    results = chain.run(docs)
"""

from .config import ChunkConfig, ExtractConfig, MergeConfig, NormalizeConfig
from .errors import ChunkError, DocloomError, ExtractionError, NormalizeError
from .operators.chunk import chunk
from .operators.detect import detect
from .operators.extract import NativeModel
from .operators.merge import merge
from .plans.pipeline import Chunked, Extracted, Merged, Normalized


def normalize(config: NormalizeConfig = NormalizeConfig()) -> Normalized:
    """Start a chain with normalisation."""
    return Normalized(config)


def extract(config: ExtractConfig) -> Extracted:
    """Start a chain with extraction: of plain texts, or of images by a vision model."""
    return Extracted(config)


__all__ = [
    "ChunkConfig", "ChunkError", "Chunked", "DocloomError", "ExtractConfig", "Extracted", "ExtractionError", "MergeConfig", "Merged",
    "NativeModel", "NormalizeConfig", "NormalizeError", "Normalized", "chunk", "detect", "extract", "merge", "normalize",
]
