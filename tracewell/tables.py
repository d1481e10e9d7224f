"""Schemas that operators share."""

ENVELOPE = "ciphertext string, nonce string, key_id string, algorithm string"
