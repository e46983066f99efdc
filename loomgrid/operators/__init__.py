"""Operators over DataFrames: ranking, boxes, masks, sequences, clusters, embeddings and merges."""
