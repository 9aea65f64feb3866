"""PySpark-native analytics over ordered, grouped sequences and the keyed documents attached to them."""
