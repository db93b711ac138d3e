"""Catalog, output formats, service, command line and the registered queries."""
