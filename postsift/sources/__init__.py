"""Listing sources; importing the package registers the built-in ones."""

from postsift.sources import boards, json_boards  # noqa: F401
