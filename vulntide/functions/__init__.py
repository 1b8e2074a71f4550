"""Scalar building blocks as SQL expressions: text in, text out.

A validation rule or a URL normal form is a tree of hundreds of nodes. As text it reaches
Spark's parser in one call, where the same tree built column by column would take seconds
per query, and again in every micro-batch of a stream. Arguments are SQL expressions too;
``F.expr`` turns a result into a column.
"""
