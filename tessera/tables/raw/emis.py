"""Raw tables of the second primary-care schema."""

from .core import ons_deaths

__all__ = ["ons_deaths"]
