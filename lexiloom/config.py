"""Typed settings read from INI files."""

from __future__ import annotations

import configparser
from dataclasses import dataclass


@dataclass(frozen=True)
class KeywordSettings:
    """Settings of the keyword job."""

    code_corpus_path: str = ""
    item_corpus_path: str = ""
    tfidf_threshold: float = 0.1
    sampling_ratio: float = 1.0
    use_default_stopwords: bool = True
    stopword_path: str = ""
    min_count: int = 10
    save_path: str = ""
    seed: int = 7

    @classmethod
    def read(cls, path: str) -> KeywordSettings:
        """Values are parsed to their types, so ``False`` is false."""
        ini = configparser.ConfigParser()
        if not ini.read(path):
            raise FileNotFoundError(path)
        # Section and key names of the settings file, spelled as they occur there.
        corpus, default = ini["corpus"], ini["default"]
        return cls(
            code_corpus_path=corpus.get("hscd_corpus_path", "").strip(),
            item_corpus_path=corpus.get("coid_corpus_path", "").strip(),
            tfidf_threshold=ini.getfloat("tfidf", "tfidf_threshold", fallback=cls.tfidf_threshold),
            sampling_ratio=default.getfloat("corpus_sampling_ratio", cls.sampling_ratio),
            use_default_stopwords=default.getboolean("use_default_stopwords", cls.use_default_stopwords),
            stopword_path=default.get("defalut_stop_path", "").strip(),
            min_count=default.getint("min_count", cls.min_count),
            save_path=ini.get("save", "save_path", fallback="").strip(),
        )


@dataclass(frozen=True)
class VectorSettings:
    """Settings of the recommendation job."""

    model_path: str = ""
    code_path: str = ""
    item_path: str = ""
    vector_save_path: str = ""
    top_n: int = 20

    @classmethod
    def read(cls, path: str) -> VectorSettings:
        ini = configparser.ConfigParser()
        if not ini.read(path):
            raise FileNotFoundError(path)
        model = ini["model"]
        return cls(
            model_path=model.get("model_path", ""),
            code_path=model.get("hscode_path", ""),
            item_path=model.get("coid_path", ""),
            vector_save_path=model.get("vector_save_path", ""),
        )
