"""Supply-chain analytics for multi-location distribution, as DataFrame operators."""
