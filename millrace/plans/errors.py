"""Errors by family, each with a stable code. Arguments are checked eagerly on the driver; bad rows get an error column instead."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors."""

    code = "UNKNOWN_ERROR"

    def __init__(self, message: str, code: str | None = None, **details):
        super().__init__(message)
        self.message = message
        self.error_code = code or self.code
        self.details = details


def _error(name: str, code: str, base: type = EngineError) -> type:
    return type(name, (base,), {"code": code, "__module__": __name__})


DocumentLoadingError = _error("DocumentLoadingError", "DOCUMENT_LOAD_ERROR")
DocumentValidationError = _error("DocumentValidationError", "DOCUMENT_VALIDATION_ERROR")
DocumentCorruptedError = _error("DocumentCorruptedError", "DOCUMENT_CORRUPTED")
UnsupportedFormatError = _error("UnsupportedFormatError", "UNSUPPORTED_FORMAT")
OCRError = _error("OCRError", "OCR_ERROR")
ChunkingError = _error("ChunkingError", "CHUNKING_ERROR")
TextProcessingError = _error("TextProcessingError", "TEXT_PROCESSING_ERROR")
EmbeddingError = _error("EmbeddingError", "EMBEDDING_ERROR")
EmbeddingAPIError = _error("EmbeddingAPIError", "EMBEDDING_API_ERROR")
VectorStoreError = _error("VectorStoreError", "VECTOR_STORE_ERROR")
IndexError_ = _error("IndexError_", "INDEX_ERROR")
RetrievalError = _error("RetrievalError", "RETRIEVAL_ERROR")
DenseRetrievalError = _error("DenseRetrievalError", "DENSE_RETRIEVAL_ERROR", RetrievalError)
BM25RetrievalError = _error("BM25RetrievalError", "BM25_RETRIEVAL_ERROR", RetrievalError)
RerankingError = _error("RerankingError", "RERANKING_ERROR")
QueryError = _error("QueryError", "QUERY_ERROR")
QueryValidationError = _error("QueryValidationError", "QUERY_VALIDATION_ERROR", QueryError)
QueryNormalizationError = _error("QueryNormalizationError", "QUERY_NORMALIZATION_ERROR", QueryError)
GenerationError = _error("GenerationError", "GENERATION_ERROR")
GenerationAPIError = _error("GenerationAPIError", "GENERATION_API_ERROR", GenerationError)
CacheError = _error("CacheError", "CACHE_ERROR")
ConfigurationError = _error("ConfigurationError", "CONFIGURATION_ERROR")
