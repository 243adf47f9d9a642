"""folioforge: a Spark-native engine that turns documents into a cross-linked, cited wiki.

Names are loaded when they are first used: the workers of a single operator need not hold the whole engine.
"""

from importlib import import_module

__version__ = "0.1.0"
_HOME = {
    "Build": "plans.engine",
    "HttpBackend": "plans.backends",
    "TreeConfig": "config",
    "Wiki": "plans.engine",
    "WikiEngine": "plans.engine",
    "from_text": "sources.pages",
    "from_texts": "sources.pages",
    "get_logger": "log",
    "read_binary": "sources.pages",
    "read_text_files": "sources.pages",
    "save_files": "operators.wiki",
    "unified_index": "operators.wiki",
    "wiki_files": "operators.wiki",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
