"""All registered queries of this package."""

from titlesieve.llm import (  # noqa: F401
    chat_queries,
    dedup_queries,
    model_queries,
    native_queries,
    spelling_queries,
    token_queries,
)
from titlesieve.llm.registry import ORACLES, QUERIES  # noqa: F401
