"""Operators for preparing training text: tokens, mixtures, scores, near copies, archives.

Nothing outside this subpackage imports it. Functions that run inside tasks import their
helpers by name, so the executors need the package on their path (`--py-files`).
"""
