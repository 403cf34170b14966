"""Settings of the retrieval engine. Defaults are those of the standard configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Ingest:
    min_words: int = 10
    max_words: int = 10_000
    sample_ratio: float = 0.5
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 256
    overlap: int = 32


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Graph:
    """The approximate index: vectors of a shard, links of a node, and how far building and searching go."""

    shard: int = 20_000
    links: int = 32
    projections: int = 4
    near: int = 4  # places apart in a projection, at first
    wide: int = 6  # lasting links over 1, 4, 16, ... places
    rounds: int = 8
    rest: float = 0.02
    beam: int = 128
    entries: int = 128
    ahead: int = 4  # nodes of a beam that are left at once
    block: int = 1024
    seed: int = 42


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 100
    rrf_k: int = 60
    n_variants: int = 3
    expand: bool = True
    bi_encoder_top_k: int = 80
    cross_encoder_top_k: int = 50
    ce_score_threshold: float = 0.0
    bi_encoder_min_score: float = 0.0


@dataclass(frozen=True)
class Generation:
    context_top_k: int = 5
    max_chunk_words: int = 150
    max_answer_sentences: int = 4
    min_ce_threshold: float = -15.0


@dataclass(frozen=True)
class Evaluation:
    k_values: tuple[int, ...] = (1, 3, 5, 10, 100)
    mrr_k: int = 10
    max_queries: int = 500
    gap: float = 0.05


@dataclass(frozen=True)
class Models:
    """``encoder``: module:function that makes a frame encoder of a model's path; the fine-tuned path counts if it is wanted and there."""

    encoder: str = ""
    base: str = ""
    fine_tuned: str = ""
    use_fine_tuned: bool = True


@dataclass(frozen=True)
class Config:
    ingest: Ingest = field(default_factory=Ingest)
    chunking: Chunking = field(default_factory=Chunking)
    bm25: Bm25 = field(default_factory=Bm25)
    graph: Graph = field(default_factory=Graph)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    evaluation: Evaluation = field(default_factory=Evaluation)
    models: Models = field(default_factory=Models)


def from_dict(values: dict) -> Config:
    """A Config from nested sections; unknown keys are ignored, missing ones keep their defaults."""
    out = Config()
    for section in fields(out):
        own = values.get(section.name) or {}
        part = getattr(out, section.name)
        known = {f.name for f in fields(part)}
        out = replace(out, **{section.name: replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known})})
    return out


def from_yaml(path: str) -> Config:
    """A Config from a YAML file of sections; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML settings needs PyYAML; from_dict takes a dict from any other reader") from e
    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})


def pick_model(fine_tuned: str, base: str, use_fine_tuned: bool, exists) -> str:
    """The fine-tuned model if the flag is set and its path exists, else the base model."""
    return fine_tuned if use_fine_tuned and exists(fine_tuned) else base
