"""Reading and writing the shop's tables, and the sample tables mapped onto them."""
