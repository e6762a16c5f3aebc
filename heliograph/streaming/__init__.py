"""Streams: watched folders, coalesced rescans, incremental identities, announcements."""
