"""Named queries over the driver's tables; importing this registers all of them."""

from . import registry, answers, assembly, contacts, context, dashboards, encodings, fallbacks, hybrid, links, markup, matching, operations, page_quality, pages, proximity, routing, states, tables, texts  # noqa: F401, I001
