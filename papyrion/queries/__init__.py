"""Registered queries, by theme. Importing this package registers all of them."""

from papyrion.queries import documents, exchange, fixtures, flow, geometry, inline, layout, markup, mining, text  # noqa: F401
