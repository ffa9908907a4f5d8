"""Inputs and outputs: catalogue tables, file trees, import rules, fixtures."""
