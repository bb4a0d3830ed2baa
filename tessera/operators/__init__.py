"""Relational operators over panels, events and stores."""
