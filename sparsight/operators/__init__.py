"""Addressing, vector search, sparse search, autoencoder and fit operators."""
