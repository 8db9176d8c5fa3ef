"""Recipes: what a distillation project of one kind needs and makes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from skein.operators import encoders


@dataclass(frozen=True)
class Material:
    """Files that a recipe needs: patterns in a folder, their expected sizes (0: any)."""

    name: str
    patterns: tuple[str, ...]
    required: bool = True
    sizes: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    name: str
    contract: str
    dim: int
    queries: int
    shard_size: int = 256
    materials: tuple[Material, ...] = ()
    teacher: Callable[[], encoders.Model] = encoders.mock_rows
    student: Callable[[], encoders.Model] = encoders.mock_tokens
    headline: tuple[str, ...] = ("cos", "rel")


RECIPES: dict[str, Recipe] = {}


def register(recipe: Recipe) -> Recipe:
    if recipe.name in RECIPES:
        raise ValueError(f"recipe {recipe.name} is there already")
    RECIPES[recipe.name] = recipe
    return recipe


register(Recipe("fixed_rows", "fixed_rows/2", 16, 4))
register(Recipe("word_rows", "word_rows/2", 16, 0, teacher=encoders.mock_tokens))


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, key by key; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def dotted(settings: dict, path: str, default: object = None) -> object:
    for k in path.split("."):
        if not isinstance(settings, dict) or k not in settings:
            return default
        settings = settings[k]
    return settings
