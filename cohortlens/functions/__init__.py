"""Scalar column functions and fixed vocabularies."""

from cohortlens.functions.exprs import *  # noqa: F401,F403
from cohortlens.functions import tokens  # noqa: F401
